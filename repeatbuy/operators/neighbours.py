"""The exact nearest points of every point of another frame.

A few points serve as pivots, and every point lies in the cell of its nearest one. A first meeting
with a part of the own cell gives each asked point an upper limit for the distance to its k-th
neighbour. By the triangle inequality a cell can then be left out when the pivot is further away than
its radius and the limit together, or when even its innermost point is too far out. Cells of many
points are cut into parts, on both sides, so no task holds a cell as a whole. Parts meet in rounds, so
that the copies made for it are bounded whatever the number of points.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatbuy.functions.skew import shuffle_width
from repeatbuy.plans.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points of a part of a cell, asked points of a part, and the most pivots: their cells meet in at
#: most PIVOTS * PIVOTS pairs.
PART = 4096
ASKED = 4096
PIVOTS = 512
ROWS = 256  # asked points compared at once
MEETING = 1 << 18  # rows that meet in one round, for each shuffle partition
FOUND = "ask long, point long, gap double"


def known(columns: Sequence[str]):
    """Whether a row has a place: no column is null, NaN or infinite."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    return fine


def distinct_points(rows: DataFrame, columns: Sequence[str], id_name: str, **sums) -> DataFrame:
    """The distinct points of ``rows``, numbered in the order of their columns, with the rows at each
    and sums over these. Rows without a place are left out. A written table."""
    x = [F.col(c).cast("double").alias(c) for c in columns]
    held = rows.filter(known(columns)).select(*x, *[e.alias(f"_{n}") for n, e in sums.items()])
    points = held.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("weight"), *[F.sum(f"_{n}").alias(n) for n in sums]
    )
    ordered = stage(points.orderBy(*columns).withColumn(id_name, F.monotonically_increasing_id()), "points")
    return ordered


def _squares(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to the pivots through a product, and a bound of their error."""
    norms, own = (pivots**2).sum(1), (x**2).sum(1)[:, None]
    return own - 2 * x @ pivots.T + norms, 1e-12 * (own + norms)


def _in_cells(rows: DataFrame, columns: Sequence[str], pivots: np.ndarray) -> DataFrame:
    """``rows`` with their cell and their distance from its pivot."""

    def run(frames):
        for pdf in frames:
            x = pdf[list(columns)].to_numpy(float)
            cell = np.zeros(len(x), np.int32)
            for at in range(0, len(x), ROWS):
                cell[at : at + ROWS] = _squares(x[at : at + ROWS], pivots)[0].argmin(1)
            yield pdf.assign(cell=cell, away=np.sqrt(((x - pivots[cell]) ** 2).sum(1)))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, schema + ", cell int, away double")


class _Cells:
    """Count, innermost and outermost distance of every cell: at most PIVOTS rows."""

    def __init__(self, placed: DataFrame, pivots: np.ndarray, most: int):
        found = placed.groupBy("cell").agg(F.count(F.lit(1)), F.min("away"), F.max("away")).collect()
        n = len(pivots)
        self.pivots = pivots
        self.count, self.inner, self.outer = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
        for cell, count, inner, outer in found:
            self.count[cell], self.inner[cell], self.outer[cell] = count, inner, outer
        self.parts = np.maximum(1, -(-self.count // most))

    def column(self):
        """Parts of the cell in column ``cell``."""
        return F.element_at(F.array(*[F.lit(int(p)) for p in self.parts]), F.col("cell") + 1)

    def limit(self, x: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` an upper limit of the k-th distance, from the limit known and from
        the cells' outer distances, and the cells that may hold a point within it."""
        square, off = _squares(x, self.pivots)
        low, high = np.sqrt(np.maximum(square - off, 0)), np.sqrt(square + off)
        reach = high + self.outer
        order = np.argsort(reach, axis=1)
        upto = np.cumsum(self.count[order], axis=1) >= k
        row = np.arange(len(x))
        place = order[row, upto.argmax(1)]
        limit = np.minimum(limit, np.where(upto[:, -1], reach[row, place], np.inf))
        slack = 1e-9 * (high + np.where(self.count > 0, self.outer, 0) + np.minimum(limit, 1e300)[:, None])
        near = (low - self.outer <= limit[:, None] + slack) & (self.inner - high <= limit[:, None] + slack)
        return limit, near & (self.count > 0)


def best_of(
    x: np.ndarray, limit: np.ndarray, pool: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` its k nearest pool points within the limit on the squared distance: row,
    id and squared distance; ties to the smaller id. Products find candidates within a margin of
    rounding, plain differences decide."""
    rows, found, gaps = [], [], []
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        square, off = _squares(part, pool)
        reach = limit[at : at + ROWS]
        if len(pool) > k:
            top = np.partition(square + off, k - 1, axis=1)[:, k - 1]
            reach = np.minimum(reach, top)
        row, place = np.nonzero(square - off <= reach[:, None])
        exact = ((part[row] - pool[place]) ** 2).sum(1)
        fine = exact <= limit[at : at + ROWS][row]
        row, place, exact = row[fine], place[fine], exact[fine]
        order = np.lexsort((ids[place], exact, row))
        row, place, exact = row[order], place[order], exact[order]
        first = np.searchsorted(row, row)  # of the same asked point
        keep = np.arange(len(row)) - first < k
        rows.append(row[keep] + at)
        found.append(ids[place[keep]])
        gaps.append(exact[keep])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(gaps)


def _meet(asked: DataFrame, held: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int) -> DataFrame:
    """Asked points (``ask``, ``near`` as limit on the squared distance) against the points they share
    keys with."""
    columns = list(columns)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        row, found, gap = best_of(
            a[columns].to_numpy(float), a["near"].to_numpy(float), b[columns].to_numpy(float),
            b["point"].to_numpy(np.int64), k,
        )
        return pd.DataFrame({"ask": a["ask"].to_numpy(np.int64)[row], "point": found, "gap": gap})

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy("gap", "point")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rounds(bounded: DataFrame, pairs: DataFrame, cells: _Cells, most: int) -> DataFrame | None:
    """The round in which every asked part meets the cells it visits, so that about ``most`` rows at a
    time are copied for it; None if one does. To the driver comes a row per asked part."""
    part = ["asked_cell", "asked_part"]
    counts = F.element_at(F.array(*[F.lit(int(n)) for n in cells.count]), F.col("cell") + 1)
    points = pairs.groupBy(*part).agg(F.sum(counts).alias("points"))
    visits = F.aggregate("cells", F.lit(0), lambda n, c: n + F.element_at(F.array(*[F.lit(int(p)) for p in cells.parts]), c + 1))
    asked = bounded.groupBy(*part).agg(F.sum(visits).alias("visits"))
    load = sorted(asked.join(points, part).select(*part, F.expr("points + visits").alias("n")).collect())
    place = np.cumsum([n for *_, n in load]) // most
    if not len(load) or place[-1] == 0:
        return None
    number = np.unique(place, return_inverse=True)[1]
    rows = [(cell, own, int(at)) for (cell, own, _), at in zip(load, number, strict=True)]
    return bounded.sparkSession.createDataFrame(rows, "asked_cell int, asked_part long, round int")


def nearest_points(asked: DataFrame, points: DataFrame, columns: Sequence[str], k: int, seed: int = 42,
                   spent: list[DataFrame] | None = None) -> DataFrame:
    """ask, point, gap and rank: for every row of ``asked`` the k nearest rows of ``points`` (all, if
    fewer) by Euclidean distance, ties to the smaller ``point``; gap is the squared distance.

    ``asked`` has a unique ``ask``, ``points`` a unique ``point``, both written tables with numbers in
    every column of ``columns``. All points take part whatever their number; the result doesn't depend
    on partitions, pivots or batches. To the driver come at most PIVOTS points and rows of counts.
    ``spent`` gets the staged tables that only the result reads.
    """
    spark, columns = points.sparkSession, list(columns)
    n = points.count()
    wanted = max(1, min(PIVOTS, math.ceil(4 * n / PART)))
    drawn = points.orderBy(F.xxhash64(F.lit(seed), "point"), "point").limit(wanted).select(*columns).collect()
    if not drawn:
        return asked.filter("false").select("ask", F.col("ask").alias("point"), F.lit(0.0).alias("gap"), F.lit(1).alias("rank"))
    pivots = np.array([[float(v) for v in row] for row in drawn])
    held = cells_at = stage(_in_cells(points.select("point", *columns), columns, pivots), "cells")
    cells = _Cells(held, pivots, PART)
    held = held.withColumn("part", F.pmod(F.xxhash64("point"), cells.column()))
    own = asked_at = stage(_in_cells(asked.select("ask", *columns), columns, pivots), "asked")
    mine = _Cells(own, pivots, ASKED)
    own = own.withColumns(
        {"asked_cell": F.col("cell"), "asked_part": F.pmod(F.xxhash64("ask"), mine.column()), "near": F.lit(float("inf"))}
    )

    # A first limit from one part of the own cell. Its points are copied to the parts asking.
    parts = F.pmod(F.xxhash64("ask", F.lit(1)), cells.column())
    copies = F.explode(F.sequence(F.lit(0).cast("long"), (mine.column() - 1).cast("long")))
    first = _meet(
        own.withColumn("part", parts), held.withColumn("asked_part", copies), ("cell", "part", "asked_part"), columns, k
    )
    limits = _best(first, k).groupBy("ask").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n"))
    limits = limits.filter(F.col("n") == k).select("ask", F.col("gap").alias("limit"))

    def visits(frames):
        for pdf in frames:
            x, near = pdf[columns].to_numpy(float), pdf["limit"].to_numpy(float)
            near = np.where(np.isnan(near), np.inf, near)
            out, all_cells = [], []
            for at in range(0, len(x), ROWS):
                bound, reached = cells.limit(x[at : at + ROWS], k, np.sqrt(near[at : at + ROWS]))
                # A limit from the first meeting is an exact square; another one is rounded up.
                out.append(np.minimum(near[at : at + ROWS], bound**2 * (1 + 1e-9)))
                all_cells += [np.flatnonzero(r).astype(np.int32).tolist() for r in reached]
            yield pdf.drop(columns="limit").assign(near=np.concatenate(out) if out else near, cells=all_cells)

    base = own.select("ask", *columns, "asked_cell", "asked_part").join(limits, "ask", "left")
    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes if c != "limit") + ", near double, cells array<int>"
    bounded = stage(base.mapInPandas(visits, schema), "visits")
    # Which part of which asked cell visits which cell: at most PIVOTS rows a part.
    pairs = bounded.select("asked_cell", "asked_part", F.explode("cells").alias("cell")).distinct()
    pairs = stage(pairs, "pairs")
    going = bounded.withColumn("cell", F.explode("cells")).drop("cells")
    going = going.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (cells.column() - 1).cast("long"))))
    if spent is not None:
        spent += [cells_at, asked_at, bounded, pairs]
    keys = ("cell", "part", "asked_cell", "asked_part")
    rounds = _rounds(bounded, pairs, cells, MEETING * shuffle_width(spark))
    if rounds is None:
        return _best(_meet(going, held.join(pairs, "cell"), keys, columns, k), k)
    turn, found = F.broadcast(rounds), []
    for i in range(rounds.agg(F.max("round")).first()[0] + 1):
        some = turn.filter(F.col("round") == i).drop("round")
        now = [x.join(some, ["asked_cell", "asked_part"], "left_semi") for x in (going, pairs)]
        found.append(stage(_best(_meet(now[0], held.join(now[1], "cell"), keys, columns, k), k), "found"))
    if spent is not None:
        spent += found
    return reduce(DataFrame.unionByName, found)
