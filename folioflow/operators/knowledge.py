"""Folding per-chapter patches into knowledge: classify, normalise, merge, project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import canonical_key, clean, utrim

# Spellings of each enumeration.
KINDS = {
    "family": ("family", "亲属", "家人"), "romantic": ("romantic", "romance", "恋爱", "感情"), "friend": ("friend", "friendship", "ally", "peer", "朋友", "互助", "借贷互助"), "ally": ("alliance", "盟友"),
    "enemy": ("enemy", "conflict", "hostile", "敌对"), "rival": ("rival", "rivalry", "竞争"),
    "superior_subordinate": ("mentor-student", "mentorstudent", "superior-subordinate", "teacher", "supervision", "师生", "诱导"),
}
POLARITY = {"positive": ("positive", "正向"), "negative": ("negative", "负向"), "mixed": ("mixed", "复杂")}
STRENGTH = {"strong": ("major", "strong", "critical", "强"), "moderate": ("moderate", "中"), "weak": ("minor", "weak", "弱")}
STATUS = {"broken": ("ended", "broken", "结束"), "developing": ("changed", "developing", "变化"), "active": ("active", "ongoing", "持续")}
EDGES = {"contains": ("contains", "part-of", "包含"), "adjacent": ("adjacent", "相邻"), "leadsTo": ("route", "leadsto", "路径")}
CATEGORY = {"basicRule": ("basic-rule", "基础规则"), "powerFaction": ("power-faction", "势力制度"), "historyLegend": ("history-legend", "历史传说"), "techMagic": ("tech-magic", "技术魔法"), "socialCulture": ("social-culture", "社会文化"), "geography": ("geography", "地理环境"), "organization": ("organization", "组织体系")}
CONFIDENCE = {"high": ("high", "已知"), "medium": ("medium", "推断"), "low": ("low", "未知")}
IMPORTANCE = {"high": ("high", "major"), "medium": ("medium", "moderate"), "low": ("low", "minor")}
PLACE_VERBS = ("located-in", "in", "at", "位于", "在", "就读")
ABILITY_VERBS, ABILITY_CHARS = ("ability", "skill", "cultivate", "learn", "master", "修炼", "学习", "掌握"), "[式术法]"
ITEM_VERBS = ("item", "owns", "purchase", "拥有", "购买")
PASSING_VERBS, PASSING_TEXT = ("see", "hear", "pass-by", "说话", "出现"), "路过|看到|出现在大屏幕"
LOW_VERBS, LOW_TEXT = ("know", "acquaintance", "schoolmate", "classmate", "认识"), "同校|认识|同屏出现|同班|路人互动"


def enum(x: Column, table: dict[str, tuple[str, ...]], default: str | None) -> Column:
    """The member of an enumeration that a spelling stands for."""
    key = canonical_key(x)
    out = None
    for name, spellings in table.items():
        out = F.when(key.isin(*spellings), name) if out is None else out.when(key.isin(*spellings), name)
    return out.otherwise(F.lit(default))


def entity_id(kind: str, name: Column) -> Column:
    """A stable id of an entity."""
    return F.concat(F.lit(f"{kind}:"), canonical_key(name))


def pair_key(a: Column, b: Column) -> Column:
    """A key that both directions of a pair share."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def classified(relations: DataFrame, people: DataFrame, places: DataFrame) -> DataFrame:
    """Adds action (keep, redirect, drop), reason, kind and a stable id to candidate relations (K4).

    relations: source_name, target_name, kind_raw, description, has_evidence; people
    and places: name. The rules hold in order. Null fields count as blank.
    """
    def known(names: DataFrame, flag: str, end: str) -> DataFrame:
        return names.select(canonical_key(F.col("name")).alias(f"_{end}")).distinct().withColumn(flag, F.lit(True))

    r = relations.withColumns({"_s": canonical_key(F.coalesce("source_name", F.lit(""))), "_t": canonical_key(F.coalesce("target_name", F.lit(""))), "_k": canonical_key(F.coalesce("kind_raw", F.lit("")))})
    for names, who in ((people, "p"), (places, "l")):
        for end in ("s", "t"):
            r = r.join(known(names, f"_{who}{end}", end), f"_{end}", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    k, said = F.col("_k"), F.coalesce("description", F.lit(""))
    edge, kind = enum(k, EDGES, None), enum(k, KINDS, None)
    ability = has("_ps") & (k.isin(*ABILITY_VERBS) | F.coalesce(F.col("target_name").rlike(ABILITY_CHARS), F.lit(False)))
    steps = [
        (~has("has_evidence"), "drop", "missing_evidence"),
        ((has("_ps") & has("_lt")) | (has("_ls") & has("_pt")) | k.isin(*PLACE_VERBS), "drop", "person_location_relation"),
        (has("_ls") & has("_lt") & edge.isNull(), "drop", "location_edge_relation"),
        (has("_ls") & has("_lt"), "redirect", "location_edge"),
        (ability, "redirect", "character_state"),
        (k.isin(*ITEM_VERBS), "drop", "person_item_relation"),
        (k.isin(*PASSING_VERBS) | said.rlike(PASSING_TEXT), "drop", "transient_action"),
        (k.isin(*LOW_VERBS) | said.rlike(LOW_TEXT), "drop", "low_value_relation"),
        (~has("_ps") | ~has("_pt"), "drop", "invalid_entity"),
        (kind.isNull(), "drop", "invalid_relation_kind"),
    ]
    action, reason = F.when(steps[0][0], steps[0][1]), F.when(steps[0][0], steps[0][2])
    for condition, a, why in steps[1:]:
        action, reason = action.when(condition, a), reason.when(condition, why)
    directed = kind == "superior_subordinate"
    ends = F.when(directed, F.concat_ws("|", "_s", "_t")).otherwise(pair_key(F.col("_s"), F.col("_t")))
    kept = action.isNull()
    return r.withColumns({"action": F.coalesce(action, F.lit("keep")), "reason": reason, "kind": F.when(kept, kind), "relation_id": F.when(kept, F.concat_ws(":", F.lit("relation"), ends, kind))}).drop("_s", "_t", "_k", "_ps", "_pt", "_ls", "_lt")


def grouped_pairs(relations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Relations of an unordered pair as one: the first one's fields, all facets in order (A3)."""
    p = relations.withColumn("pair", pair_key(F.col("source_name"), F.col("target_name")))
    # kinds once a pair before the pair is gathered: they are few, its relations may be many
    once = p.groupBy(*keys, "pair", "kind").agg(F.min_by(F.struct("source_name", "target_name", "kind"), order).alias("f"), F.min(order).alias("o"), F.count("*").alias("n"))
    g = once.groupBy(*keys, "pair").agg(F.min_by("f", "o").alias("f"), F.array_sort(F.collect_list(F.struct("o", "kind"))).alias("k"), F.sum("n").alias("n"))
    return g.select(*keys, "pair", "f.*", F.when(F.col("n") > 1, "grouped").otherwise("single").alias("direction"), F.transform("k", lambda x: x["kind"]).alias("kinds"), F.col("n").alias("relations"))


def last_known(patches: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """The last non-null value of every field of an entity: the fold of its patches in order (K5, K6)."""
    return patches.groupBy(*keys).agg(*[F.max(F.when(F.col(f).isNotNull(), F.struct(order, F.col(f).alias("v"))))["v"].alias(f) for f in fields], F.max(order).alias("last_seen"))


def capped(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most so many rows of a section (O10), a stated limit of the context.

    Spark keeps only the first rows of each group in every task before the shuffle
    (window group limit), so a hot section isn't gathered.
    """
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def state_text(fields: dict[str, Column]) -> Column:
    """A state rendered as name=a|b;... of its non-empty lists."""
    parts = [F.when(F.size(v) > 0, F.concat(F.lit(f"{k}="), F.array_join(v, "|"))) for k, v in fields.items()]
    return F.concat_ws(";", *parts)


def state_map(x: Column) -> Column:
    """A rendered state read back as a map of lists."""
    return F.transform_values(F.str_to_map(x, F.lit(";"), F.lit("=")), lambda _, v: F.split(v, r"\|"))


def richer(x: Column, order: str) -> Column:
    """The longest text of a group, the first of equals."""
    return F.max_by(x, F.struct(F.length(utrim(x)), -F.col(order)))


def chapter_states(chapters: DataFrame, digests: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Chapters with whether their digest is there (K9)."""
    there = digests.filter(clean(F.col("summary")).isNotNull()).select(*keys, index).distinct().withColumn("_d", F.lit(True))
    return chapters.join(there, [*keys, index], "left").withColumn("status", F.when(F.col("_d"), "cached").otherwise("missing")).drop("_d")


# Words of a digest that call for a patch, words of a text that do, and marks that part its words.
PATCH_WORDS = ("关系", "势力", "地点", "设定", "能力", "突破", "冲突", "身份", "加入", "离开")
GUARD_WORDS = ("加入", "背叛", "救下", "欠", "债", "师父", "同盟", "冲突", "能力", "突破", "搬到", "来到", "离开")
PARTING = r"[\s，。！？；：、“”‘’（）()《》<>\-]"
# Relations that say little, and spellings of low importance.
SMALL_RELATIONS = ("认识", "见过", "路过", "同村", "同校", "位于", "相关")
UNIMPORTANT = ("low", "低", "低重要性", "不重要", "路人", "背景", "minor", "background", "oneoff", "一次性")
# Kinds of places by their English names, and what in a name tells the kind.
PLACE_KINDS = {
    "区域": ("world", "region", "area", "zone", "realm", "secret realm"), "学校": ("school", "academy", "college", "university"), "宗门": ("sect",), "机构": ("organization", "institution", "company"),
    "建筑": ("building",), "房间": ("room",), "设施": ("facility", "site", "indoor training ground", "training ground"), "道路": ("road", "street"),
    "室外地点": ("outdoor space", "garden", "square", "playground"), "层级": ("layer", "floor", "level"), "入口": ("entrance",),
}
PLACE_NAMES = {
    "层级": ("层",), "学校": ("学校", "高中", "学院", "大学"), "宗门": ("宗门",), "机构": ("帮派", "协会", "公司", "机构"),
    "设施": ("教室", "食堂", "宿舍", "公寓", "出租房", "练功场", "办公室"), "道路": ("街道", "道路"), "室外地点": ("广场", "花园", "操场"),
}
OTHER_PLACE = "其他地点"
# Categories of notes by words in them, and the order they are shown in.
NOTE_WORDS = {
    "势力制度": ("学校", "高中", "月考", "成绩", "班级", "排名", "制度", "垄断", "资源"),
    "技术/魔法": ("符号", "羽书", "法力", "道心", "道术", "武功", "健体", "肉体强度", "请神", "邪神", "神灵", "仪式"),
    "社会文化": ("债", "开销", "补剂", "针剂", "手术", "家庭", "母亲", "家人"),
    "历史传说": ("传说", "历史", "旧神"),
    "地理环境": ("昆墟", "第一层", "第二层", "区域", "地点", "出租房", "烂尾楼"),
}
NOTE_ORDER = ("基础设定", "基础规则", "势力制度", "历史传说", "技术/魔法", "社会文化", "当前事件", "未确认信息")
META_PREFIX = "meta:"


def _has_any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(x, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(x, F.lit(w))
    return out


def needs_patch(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Adds `patch`: whether a digest or its text calls for a patch.

    rows: key, flagged, summary, key_points, text; known: name, of people and places. Words
    of undecided texts are held against the known names by an anti-join.
    """
    text = utrim(F.coalesce("text", F.lit("")))
    summary = F.coalesce("summary", F.lit(""))
    points = F.array_join(F.coalesce("key_points", F.array().cast("array<string>")), "\n")
    sure = F.when(F.coalesce("flagged", F.lit(False)), True).when(text == "", False).when((utrim(summary) == "") | _has_any(F.concat_ws("\n", points, summary), PATCH_WORDS) | F.contains(text, F.lit("→")) | _has_any(text, GUARD_WORDS), True)
    told = rows.withColumn("_sure", sure)
    words = told.filter("_sure is null").select(key, F.explode(F.array_distinct(F.split(F.col("text"), PARTING))).alias("name")).filter((F.char_length("name") >= 2) & ~F.col("name").rlike("[0-9]"))
    new = words.join(known.select("name").distinct(), "name", "left_anti").select(key).distinct().withColumn("_new", F.lit(True))
    return told.join(new, key, "left").withColumn("patch", F.coalesce("_sure", "_new", F.lit(False))).drop("_sure", "_new")


def shown_key(x: Column) -> Column:
    """A label as displays compare it: lower case, one kind of middle dot, no blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(utrim(F.coalesce(x, F.lit("")))), "[·•・]", "."), r"\s+", "")


def unimportant(importance: Column) -> Column:
    return _has_any(shown_key(importance), UNIMPORTANT)


def low_value(relation: Column, description: Column, rank: Column) -> Column:
    """A passing relation of which little is said (F14); rank: importance, 2 and more is never passing."""
    return (F.coalesce(rank, F.lit(0)) < 2) & shown_key(relation).isin(*SMALL_RELATIONS) & (F.char_length(shown_key(description)) < 18)


def visible(relations: DataFrame) -> DataFrame:
    """Relations without broken ones (F13) and passing ones (F14): status, relation, description, rank."""
    return relations.filter((F.coalesce("status", F.lit("")) != "broken") & ~low_value(F.col("relation"), F.col("description"), F.col("rank")))


def free_text(fields: list[Column], words: str) -> Column:
    """Whether the fields together have the words, whatever their case and blanks."""
    flat = lambda x: F.regexp_replace(F.lower(utrim(x)), r"\s+", "")
    asked = "".join(words.lower().split())
    return F.lit(True) if not asked else F.contains(flat(F.concat_ws(" ", *[F.when(f != "", f) for f in fields])), F.lit(asked))


def place_kind(kind: Column, name: Column) -> Column:
    """The kind of a place: a known one's, one given in ideographs, else what its name tells."""
    raw = F.when(~F.lower(utrim(kind)).isin("", "unknown"), utrim(kind))
    key = F.regexp_replace(F.lower(raw), "[_-]", " ")
    given = F.coalesce(*[F.when(key.isin(*spelled), k) for k, spelled in PLACE_KINDS.items()], F.when(raw.rlike("[\u4e00-\u9fff]"), raw))
    return F.coalesce(given, *[F.when(_has_any(name, words), k) for k, words in PLACE_NAMES.items()], F.lit(OTHER_PLACE))


def note_groups(notes: DataFrame) -> DataFrame:
    """Notes by category, one of each title, with the category's place (A18): note_id, title, content, category, importance.

    A category may be given or is told by words; titles compare as displays do; the first note of a title stays.
    """
    text = shown_key(F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), F.when(F.col("content") != "", F.col("content"))))
    inferred = F.coalesce(*[F.when(_has_any(text, words), k) for k, words in NOTE_WORDS.items()], F.lit(NOTE_ORDER[0]))
    given = utrim(F.coalesce("category", F.lit("")))
    n = notes.filter(~unimportant(F.col("importance"))).withColumns({"category": F.when(given != "", given).otherwise(inferred), "_t": shown_key(F.col("title"))})
    first = n.groupBy("category", "_t").agg(F.min("note_id").alias("note_id"), F.min_by("title", "note_id").alias("title"))
    place = F.array_position(F.array(*map(F.lit, NOTE_ORDER)), F.col("category"))
    return first.withColumn("place", F.when(place > 0, place - 1).otherwise(999)).drop("_t")


def place_parents(edges: DataFrame) -> DataFrame:
    """Of every target of a containing edge the source of the first (J10): source, target, kind, ord."""
    return edges.filter(F.col("kind") == "contains").groupBy("target").agg(F.min_by("source", "ord").alias("parent"))


def with_states(people: DataFrame, states: DataFrame, values: list[str]) -> DataFrame:
    """People with the last state of their stable id (J12): people name; states name, ord."""
    last = states.groupBy(entity_id("character", F.col("name")).alias("id")).agg(F.max_by(F.struct(*values), "ord").alias("_s"))
    return people.withColumn("id", entity_id("character", F.col("name"))).join(last, "id", "left").select(*people.columns, *[F.col("_s")[v].alias(v) for v in values])


def distinct_evidence(evidence: DataFrame, owner: list[str], order: str) -> DataFrame:
    """Evidence of each owner once by index, title, quote and note, where a null quote is blank; the first stays."""
    return evidence.withColumn("quote", F.coalesce("quote", F.lit(""))).groupBy(*owner, "chapter_index", "chapter_title", "quote", "note").agg(F.min(order).alias(order))


def folded(rows: DataFrame, keys: list[str], order: str, rules: dict[str, str]) -> DataFrame:
    """Rows of a key merged in order, each column by its own rule (A13): first, last, longest, most, union.

    Every rule is an aggregation that adds up before it moves; nulls say nothing.
    """
    made = {
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))),
        "longest": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.char_length(c), -F.col(order)))), "most": F.max, "union": lambda c: F.array_sort(F.collect_set(c)),
    }
    return rows.groupBy(*keys).agg(*[made[how](c).alias(c) for c, how in rules.items()])


def pair_tone(relations: DataFrame, pair: list[str], order: str) -> DataFrame:
    """Tone, greatest strength and label of each pair (A16): kind, polarity, strength, label.

    The tone is the first of family, romance, conflict, ally and affiliation that any
    relation has; the label joins the first three distinct ones, those without an order
    last and those of equal order by their text.
    """
    kind, polarity = F.col("kind"), F.col("polarity")
    rank = F.when(F.col("strength") == "strong", 3).when(F.col("strength") == "moderate", 2).when(F.col("strength") == "weak", 1).otherwise(0)
    # labels once a pair before the pair is gathered: they are few, its relations may be many
    once = relations.groupBy(*pair, "label").agg(
        F.min(order).alias("_o"), F.bool_or(kind == "family").alias("f"), F.bool_or(kind == "romance").alias("r"), F.bool_or(kind.isin("conflict", "rivalry") | (polarity == "negative")).alias("c"),
        F.bool_or(kind.isin("alliance", "friendship") | (polarity == "positive")).alias("a"), F.bool_or(kind.isin("affiliation", "supervision")).alias("m"), F.max(rank).alias("s"),
    )
    g = once.groupBy(*pair).agg(*[F.bool_or(x).alias(x) for x in "frcam"], F.max("s").alias("s"), F.slice(F.array_sort(F.collect_list(F.when(F.col("label") != "", F.struct(F.col("_o").isNull().alias("_none"), "_o", "label")))), 1, 3).alias("l"))
    tone = F.when(F.col("f"), "family").when(F.col("r"), "romance").when(F.col("c"), "conflict").when(F.col("a"), "ally").when(F.col("m"), "affiliation").otherwise("neutral")
    strength = F.element_at(F.array(*map(F.lit, ("unknown", "weak", "moderate", "strong"))), F.col("s") + 1)
    return g.select(*pair, tone.alias("tone"), strength.alias("strength"), F.array_join(F.transform("l", lambda x: x["label"]), " / ").alias("label"))


def changes(states: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Every state with what was before it; nothing was before the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return states.select(*keys, order, *[x for v in values for x in (F.lag(v).over(w).alias(f"previous_{v}"), F.col(v).alias(f"next_{v}"))])


def chapter_evidence(title: Column, index: Column, note: Column) -> Column:
    """Evidence made of a chapter's title and index; none without either."""
    one = F.struct(index.alias("chapter_index"), title.alias("chapter_title"), F.lit(None).cast("string").alias("quote"), note.alias("note"))
    return F.when((F.coalesce(title, F.lit("")) != "") & index.isNotNull(), F.array(one)).otherwise(F.array().cast("array<struct<chapter_index:int,chapter_title:string,quote:string,note:string>>"))


def with_meta(fields: list[str]) -> Column:
    """Fields of a relation as one text behind a prefix, and `meta_of` back."""
    return F.concat(F.lit(META_PREFIX), F.to_json(F.struct(*fields)))


def meta_of(text: Column, schema: str) -> Column:
    """The fields of such a text; null where the prefix or the JSON is missing."""
    return F.when(text.startswith(META_PREFIX), F.from_json(F.substr(text, F.lit(len(META_PREFIX) + 1)), schema))
