"""Boilerplate, residue and wrong charsets on made pages."""

from __future__ import annotations

import codecs
import random

from pyspark.sql import functions as F

from folioflow.llm import boilerplate, mojibake, pages, residue

NAMES = ["Arden", "Bela", "Corin", "Dara", "Elin", "Faro", "Gwen", "Hale", "Iris", "Joss"]


def story(rng):
    a, b = rng.sample(NAMES, 2)
    return f"{a} walked to the mill, number {rng.randrange(999)}, and asked {b} for the {rng.choice(['old map', 'brass key', 'last letter'])}, which {a} had lost on the road to the harbor."


def page(rng, body):
    lines = ["<html>", "<head><title>t</title><script>var t='{{name}}';</script></head>", "<body>", '<div class="nav"><a href="/">Home</a> <a href="/l">Library</a> <a href="/r">Rankings</a></div>', "<h1>Chapter 4</h1>", '<div class="text">', *body, "</div>", "<div>Copyright 2020 all stories are posted by members</div>", "</body>", "</html>"]
    return "\n".join(lines)


def made(spark):
    rng, rows = random.Random(3), []
    for site in range(6):
        for book in range(6):
            url = f"https://site{site}.example/{book}/1.html"
            body = [f"<p>{story(rng)}</p>" for _ in range(3)]
            if book == 1:
                body = ["Session expired, please go back."]
            if book == 2:
                body = [f"<p>{{{{content}}}} walked to the mill with {rng.choice(NAMES)}.</p>" if site % 2 else f"<p>${{content}} walked to the mill with {rng.choice(NAMES)}.</p>"]
            rows.append((site * 10 + book, page(rng, body), url))
    rows += [(900, None, "https://site0.example/9/1"), (901, "  ", "https://site0.example/9/2"), (902, '{"code":1,"msg":"Session expired, please go back."}', "https://site1.example/8/1"), (903, f"{story(rng)}\nHome | Library | Rankings\nCopyright 2021 all stories are posted by members", "https://site1.example/7/1")]
    d = spark.createDataFrame(rows, "id bigint, body string, url string")
    return pages.page_rows(d, "t", "id", "body", F.col("url"), F.regexp_extract("url", "^(.*)/[^/]*$", 1)), {r[0]: r[1] for r in rows}


def test_furniture_and_residue(spark):
    rows, bodies = made(spark)
    roles = boilerplate.classified(pages.line_segments(rows, detail=True)).cache()
    lines = {(r["row_id"], r["line_no"]) for r in boilerplate.furniture_lines(roles).collect()}
    for key, body in bodies.items():
        for n, line in enumerate((body or "").split("\n")):
            if key < 900 and key % 10 not in (1, 2):
                assert ((key, n) in lines) == ("nav" in line or "Copyright" in line), (key, line)
    assert {n for k, n in lines if k == 903} == {1, 2}
    bad = {r["row_id"] for r in residue.residue_rows(roles).collect()}
    assert bad == {k for k in bodies if k < 900 and k % 10 in (1, 2)} | {902}


def test_empty_pages(spark):
    rows, _ = made(spark)
    roles = boilerplate.classified(pages.line_segments(rows.limit(0), detail=True))
    assert boilerplate.furniture_lines(roles).count() == 0 and residue.residue_rows(roles).count() == 0


def test_html_segments_forgive_broken_markup():
    form, parts = pages.segments("<div class=a><p>one<p>two <b>bold</b>\n<script>x</script><a href=x>l</a> <a>m</a></div>stray</p>")
    assert form == "html" and [p[3] for p in parts] == ["one", "two bold", "l m", "stray"] and parts[2][4] == 1.0


def garble(text, wrong, right="utf-8"):
    return text.encode(right).decode(wrong, "replace")


def test_wrong_charsets_are_found_and_undone(spark):
    rng = random.Random(5)
    clean = ["他从临云台赶来，众人都看着破旧的竹简，再也没有提过那场大火。第%d号弟子送来书匣。" % rng.randrange(999) for _ in range(150)]
    french = ["Le forgeron évoqua la dette du capitaine, même si la clé était perdue %d fois." % rng.randrange(999) for _ in range(60)]
    bad = [garble(clean[0], "cp1252"), garble(clean[1], "cp1251"), garble(clean[2], "latin-1", "gb18030"), garble(french[0], "cp1252"), garble(french[1], "utf-8", "latin-1")]
    rows = list(enumerate(clean + french + [f"{clean[5]}\n{b}" for b in bad])) + [(998, None), (999, "")]
    d = spark.createDataFrame(rows, "id bigint, body string")
    texts = mojibake.texts_of(d, "t", "id", "body")
    got = {(r["row_id"], r["line_no"]): r["restored"] for r in mojibake.garbled_lines(texts).collect()}
    first = len(clean + french)
    assert set(got) == {(first + k, 1) for k in range(5)}
    assert got[first, 1] == clean[0] and got[first + 2, 1] == clean[2] and got[first + 3, 1] == french[0]
    assert sorted(r["row_id"] for r in mojibake.garbled_rows(mojibake.garbled_lines(texts, rows_only=True)).collect()) == list(range(first, first + 5))
    assert mojibake.garbled_lines(texts.limit(0)).count() == 0


def holed(text, every=17):
    """UTF-8 read as cp1252, bytes without a character and every 17th other one lost to a mark no charset has."""
    out = text.encode().decode("cp1252", "replace").replace("\ufffd", "\ue000")
    return "".join("\ue000" if k % every == every - 1 and c > "\x7f" else c for k, c in enumerate(out))


def test_every_rare_line_is_searched_whatever_its_length(spark):
    rng = random.Random(6)
    clean = ["他从临云台赶来，众人都看着破旧的竹简，再也没有提过那场大火。第%d号弟子送来书匣。" % rng.randrange(999) for _ in range(200)]
    rows = list(enumerate(clean)) + [(900, f"{clean[3]}\n\ue001\ue002\n{holed(clean[1])}"), (901, holed("".join(clean[10:120]))), (902, f"{clean[4]}\n\ue001\ue002")]
    texts = mojibake.texts_of(spark.createDataFrame(rows, "id bigint, body string"), "t", "id", "body")
    assert len(rows[201][1]) > 8000
    assert {r["row_id"] for r in mojibake.garbled_rows(mojibake.garbled_lines(texts, rows_only=True)).collect()} == {900, 901}


def test_the_search_for_lost_bytes_does_not_depend_on_the_number_of_records():
    codecs.register_error("byte_itself", mojibake.byte_itself)
    clean = "他从临云台赶来，众人都看着破旧的竹简，再也没有提过那场大火。"
    bad = "\ue000" + "".join(chr(b) if b in b"\x81\x8d\x8f\x90\x9d" else bytes([b]).decode("cp1252") for b in clean.encode()[1:])
    for records in (1000, 10**9):
        counts = {c: int(0.5 * records) for c in clean} | {c: int(0.03 * records) for c in bad if c > "\x7f"}
        assert mojibake.Channel({c: n / records for c, n in counts.items()}, None, records).restore(bad, 1.2)


def test_a_large_source_of_garbled_rows_stays_visible(spark):
    rng = random.Random(7)
    line = lambda: "他从临云台赶来，众人都看着破旧的竹简，再也没有提过那场大火。第%d号弟子送来书匣。" % rng.randrange(999)
    rows = [(k, line(), f"s{k % 12}") for k in range(240)] + [(1000 + k, garble(line(), "latin-1"), "hot") for k in range(120)]
    d = spark.createDataFrame(rows, "id bigint, body string, host string")
    texts = mojibake.texts_of(d, "t", "id", "body", F.col("host"))
    for rows_only in (True, False):
        assert {r["row_id"] for r in mojibake.garbled_lines(texts, rows_only=rows_only).collect()} == set(range(1000, 1120))


def test_text_garbled_twice_and_lightly_accented_text(spark):
    rng = random.Random(9)
    french = ["Le forgeron évoqua la dette du capitaine, même si la clé était perdue %d fois © 2019." % rng.randrange(999) for _ in range(200)]
    clean = ["他从临云台赶来，众人都看着破旧的竹简，再也没有提过那场大火。第%d号弟子送来书匣。" % rng.randrange(999) for _ in range(200)]
    twice = [garble(garble(x, "latin-1"), "cp1252") for x in ("竹简", french[0], clean[0])]
    once = [garble("Elle était là, sans un mot, et la porte restait close toute la nuit", "cp1252"), garble("© 2019 La clé", "mac_roman")]
    rows = list(enumerate(french + clean)) + [(900 + k, f"{french[1]}\n<p>{x}</p>") for k, x in enumerate(twice + once)]
    lines = mojibake.garbled_lines(mojibake.texts_of(spark.createDataFrame(rows, "id bigint, body string"), "t", "id", "body")).collect()
    got = {r["row_id"]: r["restored"] for r in lines}
    assert set(got) == set(range(900, 905)) and all(r["line_no"] == 1 for r in lines)
    assert got[900] == "<p>竹简</p>" and got[901] == f"<p>{french[0]}</p>" and got[903].startswith("<p>Elle était là")


def test_planted_garbling_is_found_in_real_tables(spark, sf_dir):
    """Recall and precision on clean rows of the table, every tenth garbled by one of the channels."""
    from folioflow.sources.tables import table

    rows = [(r["cache_id"], r["content"]) for r in table(spark, sf_dir.replace("0.001", "0.01"), "chapter_cache").collect() if r["content"] and "\ufffd" not in r["content"]]
    known = {r["row_id"] for r in mojibake.garbled_lines(mojibake.texts_of(spark.createDataFrame(rows, "id bigint, body string"), "t", "id", "body"), rows_only=True).collect()}
    clean = [(k, t) for k, t in rows if k not in known]
    channels, planted, made = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "gb18030"), ("gb18030", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman")], set(), []
    for n, (k, t) in enumerate(clean):
        right, wrong = channels[n // 10 % len(channels)]
        bad = t.encode(right, "ignore").decode(wrong, "replace") if n % 10 == 0 else t
        if bad != t and not t.isascii():
            planted.add(k)
        made.append((k, bad))
    texts = mojibake.texts_of(spark.createDataFrame(made, "id bigint, body string"), "t", "id", "body")
    got = {r["row_id"] for r in mojibake.garbled_lines(texts, rows_only=True).collect()}
    assert len(planted) > 30 and len(got & planted) >= 0.95 * len(planted) and len(got & planted) >= 0.95 * len(got), (len(planted), len(got), len(got & planted))
    assert got == {r["row_id"] for r in mojibake.garbled_lines(texts).collect()}
