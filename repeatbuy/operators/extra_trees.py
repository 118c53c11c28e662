"""Extremely randomised trees, all of a forest grown level by level.

A level takes two aggregations over the rows, whatever the number of trees: the range of every feature
in every open node, from which each node draws features and a cut of its own for each, and the class
counts on both sides of these cuts, by which it picks one. Tasks hand on one row per open node.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.fixed import LABEL
from repeatbuy.operators.prepare import FEATURES
from repeatbuy.operators.saving import SavedModel
from repeatbuy.plans.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 2048  # walked down the trees at once
OPEN = 1 << 15  # open nodes of one pass; a level with more takes several


class Forest:
    """Nodes of all trees: feature (-1 for a leaf), cut, left child (the right one follows it), and the
    share of class 1. Node t is the root of tree t."""

    def __init__(self, trees: int, feature=None, cut=None, left=None, share=None):
        self.trees = trees
        self.feature = np.full(trees, -1, np.int32) if feature is None else feature
        self.cut = np.zeros(trees) if cut is None else cut
        self.left = np.zeros(trees, np.int32) if left is None else left
        self.share = np.zeros(trees) if share is None else share

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        node = np.broadcast_to(np.arange(self.trees, dtype=np.int32), (len(x), self.trees)).copy()
        row, tree = np.nonzero(self.feature[node] >= 0)
        while len(row):
            at = node[row, tree]
            node[row, tree] = at = self.left[at] + (x[row, self.feature[at]] >= self.cut[at])
            deeper = self.feature[at] >= 0
            row, tree = row[deeper], tree[deeper]
        return node

    def split(self, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Give nodes two children each, with their shares of class 1; the children's numbers."""
        first = len(self.feature) + 2 * np.arange(len(node))
        self.feature[node], self.cut[node], self.left[node] = feature, cut, first
        new = 2 * len(node)
        self.feature = np.r_[self.feature, np.full(new, -1, np.int32)]
        self.cut = np.r_[self.cut, np.zeros(new)]
        self.left = np.r_[self.left, np.zeros(new, np.int32)]
        self.share = np.r_[self.share, shares.ravel()]
        return np.c_[first, first + 1].ravel()


class ExtraTrees(SavedModel):
    """Mean share of class 1 over the trees' leaves."""

    def __init__(self, forest: Forest):
        super().__init__()
        self.forest = forest

    def _transform(self, rows: DataFrame) -> DataFrame:
        forest = self.forest

        @F.pandas_udf("double")
        def mean_share(vectors: pd.Series) -> pd.Series:
            out = np.zeros(len(vectors))
            for at in range(0, len(vectors), ROWS):
                x = np.stack(vectors.iloc[at : at + ROWS].to_numpy())
                out[at : at + ROWS] = forest.share[forest.leaves(x)].mean(1)
            return pd.Series(out)

        p = F.col("_share")
        scored = rows.withColumn("_share", mean_share(vector_to_array(FEATURES)))
        return scored.withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn(
            "prediction", (p > 0.5).cast("double")
        ).drop("_share")

    def facts(self) -> dict:
        return {"trees": self.forest.trees}

    def save_table(self, path: str) -> None:
        f = self.forest
        nodes = pd.DataFrame({"node": np.arange(len(f.feature)), "feature": f.feature, "cut": f.cut, "left": f.left, "share": f.share})
        from pyspark.sql import SparkSession

        SparkSession.getActiveSession().createDataFrame(nodes).write.parquet(path)

    @classmethod
    def rebuilt(cls, facts, parts, spark, table):
        held = spark.read.parquet(table).toPandas().sort_values("node")
        kinds = {"feature": np.int32, "cut": float, "left": np.int32, "share": float}
        return cls(Forest(facts["trees"], *[held[c].to_numpy(t) for c, t in kinds.items()]))


def _over_rows(rows: DataFrame, start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Fold all rows of a task, as a matrix and class, and hand on what comes out."""

    def run(batches):
        state = start()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                values = piece.column("x").flatten().to_numpy()
                step(state, values.reshape(piece.num_rows, -1), piece.column("y").to_numpy())
        yield from finish(state)

    return rows.mapInArrow(run, schema)


def _ranges(rows: DataFrame, forest: Forest, slot: np.ndarray, n: int, p: int) -> pd.DataFrame:
    """Rows, class-1 rows, and the least and greatest value of every feature, per open node."""
    names = [f"{end}{i}" for end in ("low", "high") for i in range(p)]

    def start():
        return {"low": np.full((n, p), np.inf), "high": np.full((n, p), -np.inf), "rows": np.zeros((n, 2), np.int64)}

    def step(state, x, y):
        places = slot[forest.leaves(x)]
        for t in range(places.shape[1]):
            row = np.flatnonzero(places[:, t] >= 0)
            if not len(row):
                continue
            row = row[np.argsort(places[row, t], kind="stable")]
            own = places[row, t]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            at, part = own[first], x[row]
            state["low"][at] = np.minimum(state["low"][at], np.minimum.reduceat(part, first, axis=0))
            state["high"][at] = np.maximum(state["high"][at], np.maximum.reduceat(part, first, axis=0))
            state["rows"][at, 0] += np.diff(np.r_[first, len(row)])
            state["rows"][at, 1] += np.add.reduceat(y[row].astype(np.int64), first)

    def finish(state):
        at = np.flatnonzero(state["rows"][:, 0])
        ends = [pa.array(state[end][at, i]) for end in ("low", "high") for i in range(p)]
        counts = [pa.array(state["rows"][at, i]) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *counts, *ends], names=["slot", "n", "ones", *names])

    schema = "slot int, n long, ones long, " + ", ".join(f"{c} double" for c in names)
    made = _over_rows(rows, start, step, finish, schema)
    ends = [F.min(c).alias(c) for c in names[:p]] + [F.max(c).alias(c) for c in names[p:]]
    return made.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), *ends).toPandas().sort_values("slot")


def _sides(rows: DataFrame, forest: Forest, slot: np.ndarray, features: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows and class-1 rows on the left of each cut of each open node: (nodes, cuts, 2)."""
    n, k = cuts.shape

    def start():
        return np.zeros((n * k, 2), np.int64)

    def step(state, x, y):
        row, tree = np.nonzero((places := slot[forest.leaves(x)]) >= 0)
        own = places[row, tree]
        for j in range(k):
            left = x[row, features[own, j]] < cuts[own, j]
            at = own[left] * k + j
            state[:, 0] += np.bincount(at, minlength=n * k)
            state[:, 1] += np.bincount(at, weights=y[row[left]], minlength=n * k).astype(np.int64)

    def finish(state):
        at = np.flatnonzero(state[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(state[at, 0]), pa.array(state[at, 1])], names=["at", "n", "ones"]
        )

    made = _over_rows(rows, start, step, finish, "at int, n long, ones long")
    out = np.zeros((n * k, 2), np.int64)
    for at, count, ones in made.groupBy("at").agg(F.sum("n"), F.sum("ones")).collect():
        out[at] = count, ones
    return out.reshape(n, k, 2)


def impurity(n: np.ndarray, ones: np.ndarray, criterion: str) -> np.ndarray:
    """Gini or entropy of a node times its rows."""
    share = ones / np.maximum(n, 1)
    if criterion == "gini":
        return 2 * n * share * (1 - share)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = -share * np.log2(share) - (1 - share) * np.log2(1 - share)
    return n * np.nan_to_num(bits)


def fit_extra_trees(
    train: DataFrame, n_features: int, trees: int = 100, depth: int = 10, min_rows: int = 2,
    criterion: str = "gini", min_share: float = 0.0, seed: int = 42,
) -> ExtraTrees:
    """Trees without bootstrap: a node draws about the square root of its varying features and one
    random cut for each between that node's own ends, and takes the cut that lowers impurity most.

    The same for any partitioning: counts and ends are exact, and draws depend on tree order only.
    Nodes end at ``depth``, below ``min_rows`` rows, with one class, with no varying feature, or where
    a side would hold less than ``min_share`` of all rows. To
    the driver come one row per open node and cut, at most trees * 2**depth of them a level.
    """
    spark = train.sparkSession
    x = vector_to_array(FEATURES)
    rows = stage(train.select(x.alias("x"), F.col(LABEL).cast("double").alias("y")), "tree-rows")
    drawn = max(1, round(n_features**0.5))
    forest, open_nodes, total = Forest(trees), np.arange(trees), 0
    for level in range(depth):
        children = []
        for part, at in enumerate(range(0, len(open_nodes), OPEN)):
            node = open_nodes[at : at + OPEN]
            slot = np.full(len(forest.feature), -1, np.int32)
            slot[node] = np.arange(len(node))
            found = _ranges(rows, forest, slot, len(node), n_features)
            if not len(found):
                return ExtraTrees(forest)
            node = node[found["slot"].to_numpy()]
            n, ones = found["n"].to_numpy(np.int64), found["ones"].to_numpy(np.int64)
            low = found[[f"low{i}" for i in range(n_features)]].to_numpy(float)
            high = found[[f"high{i}" for i in range(n_features)]].to_numpy(float)
            forest.share[node] = ones / n
            total = int(n.max()) if level == 0 else total
            rng = np.random.default_rng([seed, level, part])
            turn, where = rng.random(low.shape), rng.random(low.shape)
            turn[~(high > low)] = np.inf  # NaN and constant features aren't drawn
            go = (ones > 0) & (ones < n) & (n >= min_rows) & np.isfinite(turn).any(1)
            if not go.any():
                continue
            node, n, ones = node[go], n[go], ones[go]
            turn, low, high, where = turn[go], low[go], high[go], where[go]
            features = np.argsort(turn, axis=1)[:, :drawn]
            varies = np.isfinite(np.take_along_axis(turn, features, 1))
            a, b = (np.take_along_axis(v, features, 1) for v in (low, high))
            # Between the ends, so that both sides hold a row.
            cuts = np.minimum(np.maximum(a + np.take_along_axis(where, features, 1) * (b - a), np.nextafter(a, np.inf)), b)
            slot[:] = -1
            slot[node] = np.arange(len(node))
            left = _sides(rows, forest, slot, features, np.where(varies, cuts, -np.inf))
            both = np.stack([left, np.stack([n, ones], 1)[:, None, :] - left], 2)  # node, cut, side, count
            after = impurity(both[..., 0], both[..., 1], criterion).sum(2)
            allowed = varies & (both[..., 0].min(2) >= min_share * total)
            best = np.where(allowed, after, np.inf).argmin(1)
            row = np.flatnonzero(allowed.any(1))
            if not len(row):
                continue
            node, best, features, cuts, both = node[row], best[row], features[row], cuts[row], both[row]
            row = np.arange(len(node))
            sides = both[row, best]
            children.append(forest.split(node, features[row, best], cuts[row, best], sides[..., 1] / sides[..., 0]))
        if not children:
            break
        open_nodes = np.concatenate(children)
    return ExtraTrees(forest)
