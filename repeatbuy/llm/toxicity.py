"""Toxicity: a convolutional text classifier in numpy, thresholds calibrated by language.

A word's embedding is the sum of the hashed vectors of the word and its first four and five letters;
filters of several widths slide over the whole text and each keeps its maximum; a logistic output
reads the maxima. Vectors start from a smoothed log odds of their form, then everything is trained
together. Only the position of a filter's maximum takes a gradient. Each round goes over all
labelled rows: tasks add up their gradients, Spark sums them, the driver holds the net alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.llm.common import SLICE, by_value, fold, map_slices, words
from repeatbuy.llm.quality import labelled
from repeatbuy.plans.staging import stage

by_value(__name__)

BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
FILTERS = 6
DIM = 8
SIDE = FILTERS * len(WIDTHS)  # maxima of a text
# A filter of width k reads k words; TAPS holds which maximum each row of Net.taps is part of, and
# how far behind the place of that maximum it reads.
TAPS = np.array([(j * FILTERS + f, t) for t in range(max(WIDTHS)) for j, k in enumerate(WIDTHS) if k > t for f in range(FILTERS)])
CACHED = 500_000
CHUNK = 16_384  # words of a text that are convolved at once
EDGES = b".,;:!?\"'()[]*#$%&|<>-"
ROUNDS = 12  # over all rows, at most
DONE = 0.001  # mean loss at which training ends
FINE, PULL, TAP = 1 << 24, 1 << 12, 1 << 8  # parts of one that sums are rounded to
BITS = 1 << 24  # of the map of labelled ids
GRID = np.arange(0.1, 0.95, 0.05)


def forms(word: bytes) -> tuple[int, int, int]:
    bare = (word.strip(EDGES) or word).decode("utf-8", "replace").lower()
    return tuple(
        xxhash.xxh32_intdigest(f"{n}{bare[:n]}".encode("utf-8", "replace"), 3) % BUCKETS
        for n in (len(bare) + 9, 4, 5)
    )


def kinds_rows(found: list[bytes], rows: dict[bytes, int], table: np.ndarray, fill: Callable) -> np.ndarray:
    """Rows of ``table`` for the words; ``fill`` makes those of new words. Emptied when full."""
    new = set(found).difference(rows)
    if len(rows) + len(new) > len(table):
        rows.clear()
        new = set(found)
        if len(new) > len(table):  # more kinds of words than the cache holds
            return fill(np.array([forms(w) for w in found], np.int32))
    if new:
        used = len(rows)
        rows.update(zip(new, range(used, used + len(new)), strict=True))
        table[used : used + len(new)] = fill(np.array([forms(w) for w in new], np.int32))
    return table[np.fromiter(map(rows.__getitem__, found), np.int64, len(found))]


class Net:
    def __init__(self, seed: int = 5, state: dict | None = None):
        if state is not None:
            self.__dict__.update(state)
            return
        rng = np.random.default_rng(seed)
        self.words = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.words[BUCKETS] = 0  # stands for nothing, beside short texts
        self.taps = rng.normal(0, 0.3, (len(TAPS), DIM)).astype(np.float32)
        self.taps[:, 0] = np.abs(self.taps[:, 0]) + 0.3
        self.out = np.full(SIDE, 0.2, np.float32)
        self.bias = np.float32(-1.0)

    def start(self, seen: np.ndarray, docs: np.ndarray) -> None:
        """First component of a word: how much oftener toxic documents hold it, in logarithms."""
        odds = np.log((seen[1] + 0.5) / (docs[1] + 1)) - np.log((seen[0] + 0.5) / (docs[0] + 1))
        sure = (seen[0] + seen[1]) / (seen[0] + seen[1] + 6)
        self.words[:BUCKETS, 0] = np.clip(odds * sure, -0.5, 3) / 2

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return sum(self.words.take(ids[:, i], axis=0) for i in range(3))

    def pooled(self, x_all: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over the text's vectors, and where it is. Texts are convolved in
        pieces that overlap by a width; short ones have zeros behind them."""
        if len(x_all) < max(WIDTHS):
            x_all = np.vstack([x_all, np.zeros((max(WIDTHS) - len(x_all), DIM), np.float32)])
        best = np.full(SIDE, -np.inf, np.float32)
        place = np.zeros(SIDE, np.int64)
        for start in range(0, len(x_all) - max(WIDTHS) + 1, CHUNK):
            x = x_all[start : start + CHUNK + max(WIDTHS) - 1]
            y = x @ self.taps.T
            z, at = y[:, :SIDE].copy(), SIDE
            for t in range(1, max(WIDTHS)):
                first = sum(k <= t for k in WIDTHS) * FILTERS
                z[:-t, first:] += y[t:, at : at + SIDE - first]
                at += SIDE - first
            for j, k in enumerate(WIDTHS):
                z[len(x) - k + 1 :, j * FILTERS : (j + 1) * FILTERS] = -np.inf
            found = z.argmax(axis=0)
            top = z[found, np.arange(SIDE)]
            better = top > best
            best = np.where(better, top, best)
            place = np.where(better, found + start, place)
        return best, place

    def score(self, x: np.ndarray) -> float:
        best, _ = self.pooled(x)
        z = float(np.maximum(best, 0) @ self.out + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def learn(self, sums: dict[str, np.ndarray], head_only: bool, rate: float = 0.1) -> None:
        """One step against the summed gradients: a Newton step of the output, and for all else a
        step whose length hangs on the gradient only where that is small."""
        step = np.linalg.solve(sums["curve"] + np.eye(SIDE + 1), sums["head"])
        step *= min(1, 2 / max(np.abs(step).max(), 1e-9))
        self.out = (self.out - step[:SIDE]).astype(np.float32)
        self.bias = np.float32(self.bias - step[SIDE])
        if not head_only:
            words, taps = sums["words"], sums["taps"]
            self.words[:BUCKETS] -= (rate * words / (np.abs(words) + 0.5)).astype(np.float32)
            self.taps = self.taps - (0.3 * rate * taps / (np.abs(taps) + 5)).astype(np.float32)


def summed(rows: DataFrame, make: Callable, length: int) -> np.ndarray:
    """The sum over all rows of tables of integers, ``length`` x DIM.

    ``make`` is called once in each task and returns two functions: one takes a slice's columns, the
    other gives the task's table, whose rows with anything in them are summed by Spark. Sums of
    integers don't depend on tasks or their order. To the driver come at most ``length`` rows.
    """
    names = [f"c{i}" for i in range(DIM)]

    def run(batches):
        step, result = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                step({n: piece.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
        table = result()
        at = np.flatnonzero(table.any(axis=1))
        for start in range(0, len(at), 1 << 13):
            part = at[start : start + (1 << 13)]
            columns = {"at": part} | {n: table[part, i] for i, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([(n, pa.int64()) for n in columns]))

    parts = rows.mapInArrow(run, ", ".join(f"{n} long" for n in ["at", *names]))
    found = parts.groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    total = np.zeros((length, DIM), np.int64)
    total[found["at"].to_numpy()] = np.column_stack([found[n].to_numpy() for n in names])
    return total


def unpacked(ids: bytes) -> np.ndarray:
    """The three forms of every word; texts too short for a filter have nothing behind them."""
    found = np.frombuffer(ids, np.uint16).reshape(-1, 3).astype(np.int64)
    short = max(WIDTHS) - len(found)
    return np.vstack([found, np.full((short, 3), BUCKETS)]) if short > 0 else found


def counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many documents of each label hold a form, and how many there are."""

    def make():
        seen = np.zeros((2, BUCKETS + DIM), np.int64)

        def step(cols):
            for label, ids in zip(cols["label"], cols["ids"], strict=True):
                seen[label, np.unique(np.frombuffer(ids, np.uint16))] += 1
                seen[label, BUCKETS] += 1

        return step, lambda: seen.reshape(-1, DIM)

    seen = summed(rows, make, 2 * (BUCKETS // DIM + 1)).reshape(2, -1)
    return seen[:, :BUCKETS].astype(float), seen[:, BUCKETS].astype(float)


def gradients(rows: DataFrame, net: Net) -> dict[str, np.ndarray]:
    """Sums over all rows: loss, gradients of words, taps and head (output and bias), and the
    head's second derivatives."""
    spare = -(-((SIDE + 1) * (SIDE + 2) + 1) // DIM)
    shared = rows.sparkSession.sparkContext.broadcast(vars(net))

    def make():
        net = Net(state=shared.value)
        # Of each form: by how much the errors pull where it stands under a tap of a maximum.
        pulls = np.zeros((BUCKETS + 1, len(TAPS)), np.int64)
        taps = np.zeros((len(TAPS), DIM), np.int64)
        rest = np.zeros(spare * DIM, np.int64)

        def step(cols):
            size = len(cols["ids"])
            act = np.ones((size, SIDE + 1), np.float64)
            under = np.zeros((size, len(TAPS), DIM), np.float32)
            at = np.zeros((size, len(TAPS), 3), np.int64)
            for i, packed in enumerate(cols["ids"]):
                ids = unpacked(packed)
                x = net.vectors(ids)
                best, place = net.pooled(x)
                act[i, :SIDE] = np.maximum(best, 0)
                stands = place[TAPS[:, 0]] + TAPS[:, 1]
                under[i], at[i] = x[stands], ids[stands]
            label = np.array(cols["label"])
            z = np.clip((act * np.append(net.out, net.bias)).sum(axis=1), -30, 30)
            p = 1 / (1 + np.exp(-z))
            err = p - label
            active = act[:, TAPS[:, 0]] > 0
            pull = err[:, None] * active
            whole = np.rint(pull * PULL).astype(np.int64)
            flat = at * len(TAPS) + np.arange(len(TAPS))[:, None]
            np.add.at(pulls.reshape(-1), flat.reshape(-1), np.repeat(whole.reshape(-1), 3))
            taps[:] += np.rint((pull * net.out[TAPS[:, 0]])[:, :, None] * under * FINE).astype(np.int64).sum(axis=0)
            curve = (p * (1 - p))[:, None, None] * act[:, :, None] * act[:, None, :]
            losses = np.logaddexp(0, np.where(label == 1, -z, z))
            for a, b, found in (
                (0, 1, losses[:, None]),
                (1, SIDE + 2, err[:, None] * act),
                (SIDE + 2, (SIDE + 1) * (SIDE + 2) + 1, curve.reshape(size, -1)),
            ):
                rest[a:b] += np.rint(found * FINE).astype(np.int64).sum(axis=0)

        def result():
            by = np.rint(net.out[TAPS[:, 0]][:, None] * net.taps * TAP).astype(np.int64)
            return np.vstack([pulls[:BUCKETS] @ by, taps, rest.reshape(-1, DIM)])

        return step, result

    total = summed(rows, make, BUCKETS + len(TAPS) + spare)
    shared.destroy()
    rest = total[BUCKETS + len(TAPS) :].reshape(-1) / FINE
    return {
        "words": total[:BUCKETS] / (PULL * TAP),
        "taps": total[BUCKETS : BUCKETS + len(TAPS)] / FINE,
        "loss": rest[0],
        "head": rest[1 : SIDE + 2],
        "curve": rest[SIDE + 2 : (SIDE + 1) * (SIDE + 2) + 1].reshape(SIDE + 1, SIDE + 1),
    }


def fit(rows: DataFrame, label: str = "label") -> tuple[Net, dict] | None:
    """Learn from doc_id, text, lang and a 0/1 label: from all rows with a text and a label.

    Returns the net with the least loss of all rounds, and a threshold per language, by all its
    rows. None if a label has no row. The words' forms are staged, so the texts are read once.
    """
    rows = rows.filter(F.col("text").isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(label).cast("int").alias("label"), F.col("lang").cast("string").alias("lang"), "text"
    )

    def make():
        rows: dict[bytes, int] = {}
        table = np.zeros((CACHED, 3), np.uint16)

        def step(cols):
            ids = [kinds_rows(words(t), rows, table, lambda f: f.reshape(-1, 3)) for t in cols["text"]]
            return {"label": cols["label"], "lang": cols["lang"], "ids": [i.astype(np.uint16).tobytes() for i in ids]}

        return step

    rows = stage(map_slices(rows, make, "label int, lang string, ids binary"), "forms")
    seen, docs = counted(rows)
    if not docs.all():
        return None
    net = Net()
    net.start(seen, docs)
    least, best = np.inf, vars(net)
    for done in range(ROUNDS + 1):
        sums = gradients(rows, net)
        if sums["loss"] < least:
            least, best = sums["loss"], {k: v.copy() for k, v in vars(net).items()}
        if done == ROUNDS or sums["loss"] < DONE * docs.sum():
            break
        # Words and filters wait for an output that fits them.
        net.learn(sums, head_only=done == 0)
    net = Net(state=best)
    return net, thresholds(rows, net)


def thresholds(rows: DataFrame, net: Net) -> dict:
    """Of each language the threshold with the best F1, or 0.3 where fewer than five rows are
    toxic. One row of counts per language comes to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(net))

    def make():
        net = Net(state=shared.value)

        def step(cols):
            scores = [net.score(net.vectors(unpacked(i))) for i in cols["ids"]]
            return {"label": cols["label"], "lang": cols["lang"], "score": scores}

        return step

    scored = map_slices(rows, make, "label int, lang string, score double")
    flags = [F.when(F.col("score") >= float(t), F.lit(1)).otherwise(0) for t in GRID]
    counts = [F.sum(f).alias(f"n{i}") for i, f in enumerate(flags)]
    counts += [F.sum(f * F.col("label")).alias(f"t{i}") for i, f in enumerate(flags)]
    found = scored.groupBy("lang").agg(F.sum("label").alias("toxic"), *counts).collect()
    return {r[0]: calibrate(r[1], r[2 : 2 + len(GRID)], r[2 + len(GRID) :]) for r in found}


def calibrate(toxic: int, flagged: tuple, right: tuple) -> float:
    if toxic < 5:
        return 0.3
    f1 = [2 * t / max(1, n + toxic) for n, t in zip(flagged, right, strict=True)]
    top = np.flatnonzero(np.isclose(f1, max(f1)))
    return float(GRID[top[len(top) // 2]])


def score(docs: DataFrame, model: tuple[Net, dict] | None) -> DataFrame:
    """doc_id, score (0 to 1) and flagged (score at its language's threshold) of every row.

    The score reads the text alone; lang only picks the threshold. Null and empty texts hold no
    word and get the score of none; without a model every score is 0.
    """
    # Plain arrays: a worker may not have this class.
    plain = None if model is None else (vars(model[0]), model[1])
    shared = docs.sparkSession.sparkContext.broadcast({"model": plain, "rows": {}})

    def make():
        held = shared.value["model"]
        model = held and (Net(state=held[0]), held[1])
        # A worker keeps a broadcast value from task to task, and so the words' vectors.
        rows: dict[bytes, int] = shared.value["rows"]
        table = shared.value.setdefault("table", np.zeros((CACHED if model else 1, DIM), np.float32))

        def vectors(text):
            return kinds_rows(words(text), rows, table, lambda f: model[0].vectors(f.reshape(-1, 3)))

        def step(cols):
            if model is None:
                scores = [0.0] * len(cols["text"])
                flags = [False] * len(scores)
            else:
                scores = [model[0].score(vectors(t)) for t in cols["text"]]
                flags = [s >= model[1].get(g, 0.3) for s, g in zip(scores, cols["lang"], strict=True)]
            return {"doc_id": cols["doc_id"], "score": scores, "flagged": flags}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    return map_slices(rows, make, "doc_id long, score double, flagged boolean")


def maybe_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without most of the rows that have no label, so that a join with ``labels`` moves
    fewer texts; none with a label is lost. The labels' ids set bits of a map of fixed size."""
    ids = labels.filter("doc_id is not null").select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS)).alias("bit"))
    bits = ids.groupBy(F.expr("bit div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set")
    )
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS))
    marked = docs.withColumn("bit", bit).withColumn("word", F.expr("bit div 64")).join(F.broadcast(bits), "word")
    return marked.filter("shiftright(set, cast(bit % 64 as int)) & 1 = 1").drop("bit", "word", "set")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn toxicity from the labelled rows outside fold 2 of 4 and score all rows."""
    # Labels grow with the documents: no plan that ships them whole.
    rows = labelled(maybe_labelled(docs, labels), labels.hint("merge"), "toxic", 4, 2, extra=("lang",))
    return score(docs, fit(rows)).select(
        "doc_id",
        F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "flagged",
    )
