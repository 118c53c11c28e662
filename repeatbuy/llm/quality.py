"""Quality classifier: subword embeddings, averaged per document, with a softmax output.

Each word gives hashed features: itself, its character 3- to 5-grams, its shape, and whether it
repeats the word before it. A document is the mean vector of its features. Vectors and output are
learned together by plain numpy gradient descent on a bounded sample; as the output is linear, each
feature's vector folds into one number per feature afterwards, which is all that scoring ships.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.llm.common import bounded_sample, by_value, fold, map_slices, words

by_value(__name__)

BUCKETS = 1 << 16
CACHED = 300_000
SHAPE = bytes(
    65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c >= 128 else 48 if 48 <= c < 58 else c
    for c in range(256)
)
RUN = re.compile(rb"(.)\1+", re.S)
REPEAT = crc32(b"=repeat") % BUCKETS
SIZES = (3, 4, 5)  # of character n-grams
BLOCK = 1 << 16  # code points hashed at once
FACTOR, MIX = np.uint32(0x9E3779B1), np.uint32(0x846CA68B)


def shape(word: bytes) -> bytes:
    """Kinds of characters (capital, letter, digit, any other as it is), runs shortened."""
    if word.isascii():
        kinds = word.translate(SHAPE)
    else:
        text = word.decode("utf-8", "surrogatepass")
        kinds = "".join(
            "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text
        ).encode("utf-8", "surrogatepass")
    return RUN.sub(rb"\1+", kinds)


def whole(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of their shapes."""
    own = np.fromiter((crc32(w, 1) % BUCKETS for w in words), np.int64, len(words))
    return own, np.fromiter((crc32(shape(w), 2) % BUCKETS for w in words), np.int64, len(words))


def grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each n with the hashes of the n code points from every place on that has so many."""
    state = data * FACTOR
    for n in range(2, SIZES[-1] + 1):
        state = (state[: max(0, len(data) - n + 1)] ^ data[n - 1 :]) * FACTOR
        if n in SIZES:
            ids = state + np.uint32(n)
            ids = (ids ^ (ids >> np.uint32(15))) * MIX
            yield n, ((ids ^ (ids >> np.uint32(16))) % np.uint32(BUCKETS)).astype(np.int64)


def blocks(texts: list[str], widths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Code points of the texts, each within < and >, in blocks of about ``BLOCK``: the numbers of a
    block's texts, the places where they start, and for each n the hashes at all places, with which
    of them count. A longer text has several blocks, and each n-gram counts in one of them."""
    ends, at, reach = np.cumsum(widths), 0, SIZES[-1] - 1
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - widths[at] + BLOCK, "right")))
        joined = "".join([f"<{t}>" for t in texts[at:end]])
        starts = ends[at:end] - widths[at:end]
        starts = starts - starts[0]
        for begin in range(0, max(1, len(joined) - reach), BLOCK if end == at + 1 else len(joined)):
            part = joined[begin : begin + BLOCK + reach] if end == at + 1 else joined
            data = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            # Points up to the text's end, 0 for the places that the next block counts.
            left = np.repeat(starts + widths[at:end], widths[at:end])[begin : begin + len(data)]
            left = left - np.arange(begin, begin + len(data))
            if begin + len(data) < len(joined):
                left[BLOCK:] = 0
            yield np.arange(at, end), starts, [(ids, left[: len(ids)] >= n) for n, ids in grams(data)]
        at = end


def decoded(found: list[bytes]) -> tuple[list[str], np.ndarray]:
    texts = [w.decode("utf-8", "surrogatepass") for w in found]
    return texts, np.fromiter(map(len, texts), np.int64, len(texts)) + 2


def word_features(word: bytes) -> list[int]:
    """Hashes of the word, its shape (kinds of characters, runs shortened) and its n-grams, which
    are cut by characters."""
    ids = [int(i[0]) for i in whole([word])]
    for _, _, found in blocks(*decoded([word])):
        ids += [i for at, counts in found for i in at[counts].tolist()]
    return ids


def word_sums(found: list[bytes], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the model's numbers over the features of each word, and how many features it has: as
    by ``word_features``, for many words at once."""
    total = sum((model[ids] for ids in whole(found)), np.zeros(len(found)))
    texts, widths = decoded(found)
    for numbers, starts, hashed in blocks(texts, widths):
        sums = np.zeros(len(hashed[0][0]) + SIZES[0] - 1)
        for ids, counts in hashed:
            sums[: len(ids)] += np.where(counts, model[ids], 0.0)
        total[numbers] += np.add.reduceat(sums, starts)
    return total, 2 + sum(np.maximum(widths - n + 1, 0) for n in SIZES)


class Known:
    """Words seen, with their sums: a bounded cache, emptied when full."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.sums, self.sizes = np.zeros(0), np.zeros(0, np.int64)

    def places(self, found: list[bytes], model: np.ndarray) -> np.ndarray:
        new = set(found).difference(self.place)
        if len(self.place) + len(new) > CACHED:
            self.place.clear()
            new = set(found)
        if new:
            used = len(self.place)
            fresh = list(new)
            self.place.update(zip(fresh, range(used, used + len(fresh)), strict=True))
            if len(self.place) > len(self.sums):
                room = max(len(self.place), 2 * len(self.sums))
                self.sums, self.sizes = np.resize(self.sums, room), np.resize(self.sizes, room)
            self.sums[used : used + len(fresh)], self.sizes[used : used + len(fresh)] = word_sums(fresh, model)
        return np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))


def repeats(found: list[bytes]) -> int:
    return sum(map(bytes.__eq__, found, found[1:]))


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their weights, which sum to 1 (or none)."""
    found = words(text)
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    kinds = Counter(found)
    times = np.fromiter(kinds.values(), np.float64, len(kinds))
    total = sum(np.bincount(ids, times, BUCKETS) for ids in whole(list(kinds)))
    texts, widths = decoded(list(kinds))
    for numbers, _, hashed in blocks(texts, widths):
        at = np.repeat(times[numbers], widths[numbers])
        for ids, counts in hashed:
            total += np.bincount(ids[counts], at[: len(ids)][counts], BUCKETS)
    # The mark of a repeated word stands beside the word's own ten or so features.
    if again := repeats(found):
        total[REPEAT] += 4 * again
    ids = np.flatnonzero(total).astype(np.int32)
    return ids, (total[ids] / total.sum()).astype(np.float32)


def train(
    examples: list[tuple[np.ndarray, np.ndarray, int]],
    dim: int = 16,
    epochs: int = 5,
    rate: float = 20.0,
    seed: int = 11,
) -> np.ndarray:
    """One number per feature and, last, the bias: log odds of label 1 against label 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, weights, label = examples[k]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = weights @ vectors[ids]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = output @ p
            output -= 0.05 * lr / rate * np.outer(hidden, p) * 10
            bias -= 0.02 * lr / rate * p
            vectors[ids] -= lr * np.outer(weights, back)
    fold_in = vectors @ (output[:, 1] - output[:, 0])
    return np.append(fold_in, bias[1] - bias[0]).astype(np.float64)


def fit(rows: DataFrame, label: str = "label", max_train: int = 1000) -> np.ndarray | None:
    """Learn from doc_id, text and a 0/1 label. About ``max_train`` rows of each label are used;
    rows without a text or label are not. With fewer than two labels there is nothing to learn:
    None."""
    rows = rows.filter(F.col("text").isNotNull() & F.col(label).isin(0, 1)).select(
        "doc_id", "text", F.col(label).cast("int").alias("label")
    )
    sample = bounded_sample(rows, "label", max_train)

    def make():
        def step(cols):
            found = [document_features(t) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "label": cols["label"],
                "ids": [f[0] for f in found],
                "weights": [f[1] for f in found],
            }

        return step

    schema = "doc_id long, label int, ids array<int>, weights array<float>"
    sample = map_slices(sample.select(F.col("doc_id").cast("long"), "text", "label"), make, schema)
    examples = sorted(
        ((r[0], r[1], np.asarray(r[2], np.int32), np.asarray(r[3], np.float32)) for r in sample.toLocalIterator()),
        key=lambda r: (r[0] is None, r[0] or 0, len(r[2])),
    )
    examples = [(ids, weights, label) for _, label, ids, weights in examples if len(ids)]
    if len({e[2] for e in examples}) < 2:
        return None
    return train(examples)


def score(docs: DataFrame, model: np.ndarray | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row.

    Null and empty texts get the bias alone; without a model every score is 0.5.
    """
    # A worker keeps a broadcast value from task to task, and so the cache.
    shared = docs.sparkSession.sparkContext.broadcast({"model": model})

    def make():
        model = shared.value["model"]
        known = shared.value.setdefault("known", Known())

        def one(text):
            if model is None:
                return 0.5
            found = words(text)
            total, n = 0.0, 0
            if found:
                at = known.places(found, model)
                total, n = known.sums[at].sum(), int(known.sizes[at].sum())
                if again := int(np.count_nonzero(at[1:] == at[:-1])):
                    total += 4 * again * model[REPEAT]
                    n += 4 * again
            z = model[-1] + (total / n if n else 0.0)
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return lambda cols: {"doc_id": cols["doc_id"], "score": [one(t) for t in cols["text"]]}

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return map_slices(rows, make, "doc_id long, score double")


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, extra: tuple = ()
) -> DataFrame:
    """Rows to learn from: those outside the held-out fold, with their label. Labels that
    contradict each other for one id are left out."""
    one = (
        labels.groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .filter("label = most")
        .select("doc_id", "label")
    )
    return docs.filter(fold(folds) != held).select("doc_id", "text", *extra).join(one, "doc_id")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn quality from the labelled rows outside fold 1 of 3 and score all rows."""
    model = fit(labelled(docs, labels, "quality", 3, 1))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
