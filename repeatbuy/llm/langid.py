"""Language identification by words, backing off to shorter and shorter character n-grams.

Fit: words and n-grams are counted per language over a bounded sample of labelled rows. Predict: a
word known in any language scores its logarithmic relative frequency in each of them; a word known
in none is scored by the mean of its known 5-grams, else of its 4-grams, down to single characters.
A text's score is the mean over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repeatbuy.llm.common import by_value, fold, map_slices

by_value(__name__)

WORDS = re.compile(r"[^\W\d_]+")
UNSEEN = -7.0  # log10 frequency where a language lacks a word or n-gram that another one has
LONGEST = 5
CACHED = 400_000  # tokens whose scores a worker keeps, fewer with many languages
CACHED_SCORES = 4 * CACHED
KEPT = 4_500_000  # scores of a model, over all languages


def letters(token: str) -> list[str]:
    """Runs of letters: of characters that are letters by their Unicode category."""
    found = WORDS.findall(token)
    if all(map(str.isalpha, found)):
        return found
    # Numbers that aren't digits, such as a half, count among the characters of words above.
    return ["".join(run) for word in found for alpha, run in groupby(word, str.isalpha) if alpha]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def fit(
    rows: DataFrame,
    sample_docs: int = 3000,
    max_words: int = 30_000,
    max_grams: int = 8_000,
) -> tuple[list[str], dict[str, list[tuple[int, float]]]]:
    """Learn from ``text`` and ``lang`` of ``rows`` (null texts and languages take no part).

    Every language is learned. Bounds: about ``sample_docs`` rows of each; per language the
    ``max_words`` most frequent words and ``max_grams`` n-grams of each length, fewer where all
    languages together would pass KEPT scores. A word or n-gram holds its score in the languages that
    have it, so the model is bounded and may be broadcast. To the driver comes a row per language and
    score. No rows give an empty model.
    """
    rows = rows.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().collect()
    part = min(1.0, KEPT / max(1, len(sizes) * (max_words + LONGEST * max_grams)))
    max_words, max_grams = max(1, int(part * max_words)), max(1, int(part * max_grams))
    shares = [(lang, min(1 << 62, sample_docs * (1 << 62) // size)) for lang, size in sizes]
    shares = rows.sparkSession.createDataFrame(shares, "lang string, bound long")
    place = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 62))
    counted = (
        rows.join(F.broadcast(shares), "lang")
        .filter(place < F.col("bound"))
        .select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("gram"))
        .filter("gram != ''")
        .groupBy("lang", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    ).persist()
    padded = F.concat(F.lit(" "), "gram", F.lit(" "))
    pieces = counted.select(
        "lang",
        "n",
        F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size"),
        padded.alias("padded"),
    ).filter("length(padded) >= size")
    pieces = pieces.select(
        "lang",
        "size",
        "n",
        F.explode(F.expr("transform(sequence(1, length(padded) - size + 1), i -> substring(padded, i, size))")).alias("gram"),
    )
    both = counted.select("lang", F.lit(0).alias("size"), "gram", "n").unionByName(
        pieces.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    )
    per = Window.partitionBy("lang", "size")
    best = (
        both.withColumn("place", F.row_number().over(per.orderBy(F.desc("n"), "gram")))
        .filter(F.col("place") <= F.when(F.col("size") == 0, max_words).otherwise(max_grams))
        .withColumn("share", F.col("n") / F.sum("n").over(per))
    )
    langs = sorted(r[0] for r in sizes)
    at = {lang: i for i, lang in enumerate(langs)}
    known: dict[str, list[tuple[int, float]]] = {}
    for r in best.select("lang", "size", "gram", "share").toLocalIterator():
        known.setdefault(f"{r[1]}{r[2]}", []).append((at[r[0]], float(np.log10(r[3]))))
    counted.unpersist()
    return langs, known


class Scorer:
    def __init__(self, langs: list[str], known: dict[str, list[tuple[int, float]]]):
        self.langs, self.known = langs, known
        self.kept = max(1024, min(CACHED, CACHED_SCORES // max(len(langs), 1)))
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(langs)))
        self.counts = np.zeros(1024)

    def word(self, word: str) -> np.ndarray:
        """The word's score in each language, by the longest kind of piece that is known."""
        if (found := self.known.get(f"0{word}")) is not None:
            return self.scores([found])
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            hits = [v for g in grams(word, n) if (v := self.known.get(f"{n}{g}")) is not None]
            if hits:
                return self.scores(hits)
        return self.scores([[]])

    def scores(self, hits: list[list[tuple[int, float]]]) -> np.ndarray:
        """Mean over the hits; a language that lacks one counts UNSEEN there."""
        out = [UNSEEN * len(hits)] * len(self.langs)
        for found in hits:
            for at, value in found:
                out[at] += value - UNSEEN
        return np.array(out) / len(hits)

    def row(self, token: str) -> int:
        """Row of a token between spaces: the sum over its words and their number."""
        if len(self.rows) >= self.kept:
            self.rows.clear()
        at = self.rows[token] = len(self.rows)
        if at >= len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        found = letters(token)
        self.table[at] = sum((self.word(w) for w in found), np.zeros(len(self.langs)))
        self.counts[at] = len(found)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs:
            return "und", 0.0
        seen = Counter(text.lower().split())
        if len(self.rows) + len(seen) > self.kept:
            self.rows.clear()
        if len(seen) > self.kept:  # more kinds of words than the cache holds: word by word
            total, n = np.zeros(len(self.langs)), 0
            for token, times in seen.items():
                for w in letters(token):
                    total, n = total + times * self.word(w), n + times
        else:
            at = np.fromiter(
                (r if (r := self.rows.get(t)) is not None else self.row(t) for t in seen),
                np.int64,
                len(seen),
            )
            times = np.fromiter(seen.values(), np.float64, len(seen))
            total, n = times @ self.table[at], times @ self.counts[at]
        if not n:
            return "und", 0.0
        mean = total / n * np.log(10)
        best = int(np.argmax(mean))
        return self.langs[best], float(1 / np.exp(mean - mean[best]).sum())


def predict(docs: DataFrame, model: tuple[list[str], dict[str, list[tuple[int, float]]]]) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1, the share of the best language) of every row.

    Null texts, texts without a letter and an empty model give ``und`` with score 0; ties go to the
    language first in the alphabet; repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"model": model})

    def make():
        # A worker keeps a broadcast value from task to task, and so the scorer with its cache.
        held = shared.value
        if "scorer" not in held:
            held["scorer"] = Scorer(*held["model"])
        scorer = held["scorer"]

        def step(cols):
            found = [scorer.predict(t) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "lang_pred": [f[0] for f in found],
                "score": [f[1] for f in found],
            }

        return step

    return map_slices(
        docs.select(F.col("doc_id").cast("long"), "text"),
        make,
        "doc_id long, lang_pred string, score double",
    )


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside fold 2 of 4 and predict all rows."""
    model = fit(docs.filter(fold(4) != 2))
    return predict(docs, model).withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
