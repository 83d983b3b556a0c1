"""Broken prompt and response pairs (problem 4).

Method: a multi-label linear classifier over hashed character n-grams of the
answer and features of the pair (how much of the answer the content holds, how
the answer ends, which script and which short words both use). It is trained on
a bounded sample of the pairs themselves, made defective on purpose: truncated,
copied from the content, swapped with an answer in another language, replaced by
a refusal or emptied. Thresholds are calibrated on held-out made pairs. Training
runs twice; pairs the first model finds defective are left out of the second's
sound examples. Everything else, joining and scoring, covers all rows.

Documented bound: `sample_rows` pairs (1,200 by default), taken by hash of the id.

Defined results: an answer without a request is scored against empty content; a
request answered several times, or asked several times, gives each answer one
verdict against the latest request; null summaries and null or empty lists of
key points count as absent, and only a missing summary is a defect; empty tables
give an empty result; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import spread, written

LABELS = ["empty", "truncated", "refusal", "copied", "other_language"]
SCHEMA = "summary_id bigint, defect string, margin double"
DIM, GRAM = 1024, 8

# Answers that stand for none.
STAND_INS = ["", " ", "\n", "　", "-", "--", "—", "…", "……", "...", ".", "/", "[]", "{}", "()", "\"\"", "null", "None", "none", "NULL", "nil", "N/A", "n/a", "NA", "无", "暂无", "没有", "空", "（空）", "(空)", "（无）", "(empty)", "empty", "TBD", "待补充", "aucun", "néant", "vide"]

# Parts refusals are made of, by language: openings, then what is refused.
REFUSALS = {
    "zh": (
        ["抱歉，我无法{}。", "对不起，我不能{}。", "很抱歉，我无法{}。", "非常遗憾，我不能{}。", "作为人工智能助手，我不能{}。", "作为AI，我无法{}，请谅解。", "作为语言模型，我无法{}。", "根据使用政策，我不能{}。", "由于内容限制，无法{}。", "该内容可能违反规范，暂时不能{}。", "该请求涉及敏感内容，无法{}。", "我没有办法{}。", "恕我不能{}。", "您的请求已被拒绝，系统未能{}。", "不便{}，请见谅。", "这个请求我帮不上忙，不允许{}。", "您提供的内容超出了我的处理范围，无法{}。"],
        ["总结这段内容", "概括本章", "生成摘要", "完成这个请求", "提供您需要的梗概", "处理这段文字", "归纳正文", "协助您"],
        ["", "", "请更换章节后再试。", "请稍后再试。", "建议您阅读原文。", "如有其他问题，欢迎提出。"],
    ),
    "en": (
        ["I’m sorry, but I can’t {}.", "I am sorry, I cannot {}.", "Sorry, I’m not able to {}.", "I’m unable to {}.", "Unfortunately, I can’t {}.", "As an AI language model, I cannot {}.", "As a language model, I am unable to {}.", "My guidelines prevent me from being able to {}.", "This request goes against my policies, so I won’t {}.", "I must decline to {}.", "It would not be appropriate for me to {}.", "I cannot help to {} at this time."],
        ["summarize this text", "summarise the chapter", "help with that", "help with this request", "provide a summary", "process this content", "condense the passage", "assist with this text"],
        ["", "", "Please try again later.", "Please try another chapter.", "You may want to read the original."],
    ),
    "fr": (
        ["Désolé, je ne peux pas {}.", "Je suis désolé, mais je ne peux pas {}.", "Je regrette, mais je ne suis pas en mesure de {}.", "Malheureusement, je ne peux pas {}.", "En tant que modèle de langue, il m’est impossible de {}.", "En tant qu’assistant, je ne peux pas {}.", "Mes règles m’interdisent de {}.", "Je dois refuser de {}."],
        ["résumer ce texte", "résumer ce chapitre", "fournir un résumé", "traiter cette demande", "vous aider", "traiter ce contenu"],
        ["", "", "Veuillez réessayer plus tard.", "Je vous invite à lire l’original."],
    ),
}

# Common words of languages in Latin letters.
COMMON = {
    "en": "the and of to in that was is with for his her had not but from they she you were".split(),
    "fr": "le la les des et que un une du dans pour est pas qui sur avec se ne au ce".split(),
    "de": "der die und das den von ist mit sich auf dem nicht ein eine zu war als auch wie".split(),
    "es": "el los las una por con para como pero su lo mas fue del al sus esta muy".split(),
    "it": "il che di non gli una per con del della sono era alla anche come piu nel".split(),
}

_NO_LETTER = re.compile(r"[\W_]+")
_HAN = re.compile("[㐀-鿿]")
_LATIN = re.compile(r"[^\W\d_㐀-鿿]+")
_SENTENCE = re.compile(r"[^。！？!?.…\n]+[。！？!?.…]*[”’\"»]?")
_END = re.compile(r"[。！？.!?…][”’\"'»）)」』】\]]*$|[）)】]$")
_DOTS = re.compile(r"(?:…|\.{3})$")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, np.uint64(1469598103934665603 + seed))
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ codes[i : i + n]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _letters(text: str) -> str:
    return _NO_LETTER.sub("", text.lower())


def _han_share(text: str) -> float:
    han = len(_HAN.findall(text))
    return han / max(1, han + sum(len(w) for w in _LATIN.findall(text)) / 3)


def language(text: str) -> str:
    """han, a language in Latin letters by its common words, or nothing where they don't tell."""
    if _han_share(text) > 0.35:
        return "han"
    words = _LATIN.findall(text.lower())
    scores = sorted(((sum(w in own for w in words), name) for name, own in _COMMON.items()), reverse=True)
    return scores[0][1] if scores[0][0] > scores[1][0] else ""


_COMMON = {name: frozenset(words) for name, words in COMMON.items()}


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among sorted known ones."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Pair:
    """What the features of a pair are made from; the content's part is shared by made variants."""

    def __init__(self, content: str):
        codes = _codes(_letters(content))
        self.grams, self.two = np.unique(_grams(codes, GRAM)), np.unique(_grams(codes, 2))
        self.han = _han_share(content)
        self.language = language(content)
        self.long = {w for w in _LATIN.findall(content.lower()) if len(w) > 4}

    def held(self, text: str) -> float:
        g = _grams(_codes(_letters(text)), GRAM)
        return float(_within(g, self.grams).mean()) if len(g) else 0.0

    def grounded(self, text: str) -> float:
        """The share of an answer's pairs of ideographs, or of its longer words, that the content has."""
        if _han_share(text) > 0.35:
            two = _grams(_codes(_letters(text)), 2)
            return float(_within(two, self.two).mean()) if len(two) else 0.0
        words = [w for w in _LATIN.findall(text.lower()) if len(w) > 4]
        return float(np.mean([w in self.long for w in words])) if words else 0.0

    def strange(self, text: str) -> float:
        """How sure it is that a text isn't in the content's language: 0 to 1."""
        if not _letters(text):
            return 0.0
        own = language(text)
        if "han" in (own, self.language) and own != self.language:
            return 1.0
        return 0.3 if not own or not self.language else float(own != self.language)

    def dense(self, summary: str, points: list[str]) -> list[float]:
        text = summary.strip()
        letters = _letters(text)
        points = [p for p in points if _letters(p)]
        held = self.held(text)
        sentences = [s for s in _SENTENCE.findall(text) if len(_letters(s)) >= GRAM]
        each = [self.held(s) for s in sentences]
        most = float(np.mean([h > 0.5 for h in each])) if each else 0.0
        points_held = min((self.held(p) for p in points if len(_letters(p)) >= GRAM), default=0.0)
        ground = self.grounded(text)
        ends = bool(_END.search(text))
        strange, points_strange = self.strange(text), min((self.strange(p) for p in points), default=0.0)
        quotes = abs(text.count("“") - text.count("”")) + abs(text.count("«") - text.count("»")) + abs(text.count("{") - text.count("}"))
        return [
            1.0, float(len(letters) <= 4), float(not letters), min(len(letters), 60) / 60, held, float(held > 0.5), most, float(most > 0.8), points_held, float(points_held > 0.6),
            float(ends), float(not ends and len(letters) > 4), float(bool(_DOTS.search(text))), float(quotes > 0), strange, 2.0 * (strange > 0.6), points_strange, 2.0 * (points_strange > 0.6),
            ground, 0.4 * (ground < 0.12 and len(letters) > 4), float(len(points) > 0), float(text.startswith(("{", "["))),
        ]


DENSE, GRAM_WEIGHT = 22, 1.0


def features(pair: Pair, summary: str, points: list[str]) -> np.ndarray:
    out = np.zeros(DENSE + 2 * DIM, dtype=np.float32)
    out[:DENSE] = pair.dense(summary, points)
    codes = _codes(re.sub(r"\d+", "#", summary.strip().lower()))
    for at, part in ((DENSE, codes), (DENSE + DIM, codes[-4:])):  # n-grams anywhere, and at the end
        for k in (1, 2, 3) if at == DENSE + DIM else (2, 3):
            g = (_grams(part, k, seed=k + at) % np.uint64(DIM)).astype(np.int64)
            if len(g):
                out[at + g] = 1.0
    norm = np.sqrt(out[DENSE:].sum())
    if norm:
        out[DENSE:] *= GRAM_WEIGHT / norm
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def verdict(self, x: np.ndarray) -> tuple[str | None, float]:
        margins = x @ self.weights - self.thresholds
        k = int(np.argmax(margins))
        return (LABELS[k], float(margins[k])) if margins[k] > 0 else (None, float(margins[k]))


def _made(rng: np.random.Generator, rows: list[tuple[str, list[str], str]], pairs: list[Pair]) -> Iterator[tuple[Pair, str, list[str], int]]:
    """(pair, summary, points, label or -1) of every sound row and its made defects."""
    others = list(range(len(rows)))
    for (summary, points, content), pair in zip(rows, pairs):
        yield pair, summary, points, -1
        yield pair, summary, [], -1
        if pair.han > 0.35 and rng.random() < 0.2:  # dots behind a whole sentence are no truncation
            yield pair, re.sub("[。！？]+$", "", summary.strip()) + "……", points, -1
        text = summary.strip()
        if len(text) > 12:  # broken off within a sentence, with or without a mark
            cut = int(rng.integers(max(4, len(text) // 5), len(text) - 2))
            while cut > 4 and (text[cut - 1] in "。.！？!?…”’）)」\n " or _END.search(text[:cut])):
                cut -= 1
            whole = text[:cut] if rng.random() > 0.15 else '{"summary":"' + text[:cut]
            yield pair, whole + str(rng.choice(["", "", "", "", "", "", "", "", "", "", "…", "..."])), points if rng.random() < 0.7 else [], 1
        sentences = [s.strip() for s in _SENTENCE.findall(content) if len(_letters(s)) >= 6]
        if sentences:
            n = int(rng.integers(1, 6))
            first = int(rng.integers(0, max(1, len(sentences) - n)))
            taken = sentences[first : first + n] if rng.random() < 0.7 else [sentences[k] for k in rng.permutation(len(sentences))[:n]]
            copied = ("" if pair.han > 0.35 else " ").join(taken)
            if rng.random() < 0.5 and len(copied) > 20:  # small changes
                for _ in range(max(1, len(copied) // 50)):
                    k = int(rng.integers(0, len(copied) - 3))
                    copied = copied[:k] + copied[k + int(rng.integers(1, 3)) :]
            if rng.random() < 0.75:
                yield pair, copied, points if rng.random() < 0.6 else taken[:3], 3
            else:
                yield pair, summary, taken[:3], 3
            # a short quotation alone is no defect
            quoted = taken[0][:14].strip("“”«» ")
            yield pair, (f"{summary}文中写道“{quoted}”，可见其用意。" if pair.han > 0.35 else f"{summary} “{quoted}”, it says."), points, -1
        strangers = [k for k in rng.permutation(others)[:12] if pair.strange(rows[k][0]) > 0.6]
        if strangers:
            s, p, _ = rows[strangers[0]]
            yield pair, s, p if rng.random() < 0.5 else points, 4
            stranger_points = [q for k in strangers for q in rows[k][1]][:3]
            if stranger_points:
                yield pair, summary, stranger_points, 4
        language = "zh" if pair.han > 0.35 else str(rng.choice(["en", "fr"]))
        if rng.random() < 0.15:
            language = str(rng.choice(list(REFUSALS)))
        opening, what, close = (REFUSALS[language][k] for k in range(3))
        said = [str(rng.choice(opening)).format(rng.choice(what)) for _ in range(1 + int(rng.random() < 0.3))]
        yield pair, (" " if language != "zh" else "").join([*said, str(rng.choice(close))]).strip(), [] if rng.random() < 0.7 else [str(rng.choice(what))], 2
        yield pair, str(rng.choice(STAND_INS)), [] if rng.random() < 0.7 else [str(rng.choice(STAND_INS))], 0


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """One-against-all logistic regression by Adam on the whole batch."""
    w = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _calibrated(scores: np.ndarray, y: np.ndarray, sound_weight: float = 5.0) -> np.ndarray:
    """Of each label the threshold of the best F1 on held-out pairs; sound ones weigh more, as there are more of them."""
    out = np.zeros(scores.shape[1], dtype=np.float32)
    for k in range(scores.shape[1]):
        order = np.argsort(-scores[:, k])
        hit = np.cumsum(y[order, k])
        wrong = np.cumsum(np.where(y[order, k] > 0, 0.0, np.where(y[order].sum(axis=1) == 0, sound_weight, 1.0)))
        f1 = 2 * hit / np.maximum(1e-9, hit + wrong + y[:, k].sum())
        best = int(np.argmax(f1))
        low = scores[order[best], k]
        high = scores[order[best + 1], k] if best + 1 < len(order) else low - 1
        out[k] = (low + high) / 2
    return out


def _looks_sound(pair: Pair, summary: str, points: list[str]) -> bool:
    """Whether a pair may serve as a sound example: whatever the features, no defect is plain."""
    text = summary.strip()
    return (
        len(_letters(text)) > 4 and bool(_END.search(text)) and pair.held(text) < 0.5 and pair.strange(text) < 0.6 and pair.grounded(text) >= 0.1
        and not (points and min(pair.held(p) for p in points) > 0.5) and not (points and min(pair.strange(p) for p in points) > 0.6)
    )


def train(rows: list[tuple[str, list[str], str]], seed: int = 7) -> Model:
    """Two rounds: the second leaves out rows the first finds defective."""
    model, pairs = None, [Pair(c) for _, _, c in rows]
    plain = [k for k, (s, p, _) in enumerate(rows) if _looks_sound(pairs[k], s, p)]
    own = {k: features(pairs[k], rows[k][0], rows[k][1]) for k in plain}
    for steps in (100, 250):  # the first round only tells which pairs to leave out
        rng = np.random.default_rng(seed)
        sound = plain if model is None else [k for k in plain if model.verdict(own[k])[0] is None]
        if len(sound) < 20:
            return model or Model(np.zeros((DENSE + 2 * DIM, len(LABELS)), dtype=np.float32), np.full(len(LABELS), 1.0, dtype=np.float32))
        x, y = [], []
        for pair, summary, points, label in _made(rng, [rows[k] for k in sound], [pairs[k] for k in sound]):
            x.append(features(pair, summary, points))
            y.append([float(k == label) for k in range(len(LABELS))])
        x, y = np.array(x), np.array(y, dtype=np.float32)
        held = rng.random(len(x)) < 0.25
        weights = _fit(x[~held], y[~held], steps)
        model = Model(weights, _calibrated(x[held] @ weights, y[held]))
    return model


def joined_pairs(answers: DataFrame, requests: DataFrame, keys: tuple[str, ...] = ("user_ns", "book_url", "chapter_url"), id_col: str = "summary_id", summary_col: str = "summary", points_col: str = "key_points", content_col: str = "content", order_col: str = "request_id") -> DataFrame:
    """(summary_id, summary, points, content): every answer with the content of its latest request."""
    names = [f"k{n}" for n in range(len(keys))]
    asked = requests.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)], F.col(order_col).alias("asked"))
    latest = asked.groupBy(*names).agg(F.max("asked").alias("asked"))
    given = answers.select(F.col(id_col).cast("bigint").alias("summary_id"), F.coalesce(F.col(summary_col).cast("string"), F.lit("")).alias("summary"), F.coalesce(F.col(points_col), F.array()).cast("array<string>").alias("points"), *[F.col(k).cast("string").alias(f"a{n}") for n, k in enumerate(keys)])
    on = [F.col(f"a{n}").eqNullSafe(F.col(f"k{n}")) for n in range(len(keys))]
    # the request is told by its short columns; the contents are shuffled once, to the answers
    given = given.join(latest, on, "left").select("summary_id", "summary", "points", "asked")
    contents = requests.select(F.col(order_col).alias("asked"), F.col(content_col).cast("string").alias("content"))
    return given.join(contents, "asked", "left").select("summary_id", "summary", "points", F.coalesce("content", F.lit("")).alias("content"))


def defective_pairs(answers: DataFrame, requests: DataFrame, sample_rows: int = 1200, **columns) -> DataFrame:
    """(summary_id, defect, margin) of every defective answer."""
    pairs = written(joined_pairs(answers, requests, **columns), "pairs")  # read for the sample and to be scored
    spark = pairs.sparkSession
    ids = answers.select(F.col(columns.get("id_col", "summary_id")).alias("i")).orderBy(F.xxhash64("i"), "i").limit(sample_rows)  # the documented bound of the training sample
    sample = pairs.join(F.broadcast(ids), pairs["summary_id"] == ids["i"], "left_semi").toPandas().sort_values("summary_id")
    rows = [(s, [p or "" for p in ps], c) for s, ps, c in zip(sample["summary"], sample["points"], sample["content"])]
    trained = train(rows)
    sent = spark.sparkContext.broadcast((trained.weights, trained.thresholds))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*sent.value)
        for batch in batches:
            out = []
            for key, summary, points, content in zip(batch["summary_id"], batch["summary"], batch["points"], batch["content"]):
                defect, margin = model.verdict(features(Pair(content), summary, [p or "" for p in points]))
                if defect:
                    out.append((key, defect, margin))
            yield pd.DataFrame(out, columns=["summary_id", "defect", "margin"])

    return spread(pairs).mapInPandas(score, SCHEMA)
