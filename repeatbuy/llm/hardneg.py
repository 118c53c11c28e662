"""Hard negatives by inner product, found through coordinates in buckets of vectors of like length.

Vectors are sorted by falling length and cut into buckets, each a packed matrix with one sorted list
for every coordinate of its unit vectors. A search is a set of windows of scores around an anchor,
with a number of best rows wanted in each. The bucket of the longest vectors gives every window a
bound that no answer falls below. Against another bucket the bound becomes a threshold on the
cosine: above 1 the bucket is skipped, and below that a row's length, and its value at the anchor's
largest coordinates (its focus), must lie in feasible ranges. The shortest range is read off its
sorted list and cut down by the others; what is left is verified by exact integer products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from repeatbuy.functions.skew import shuffle_width
from repeatbuy.llm.arrays import matrix, pack, scaled, small, unpack, whole
from repeatbuy.llm.common import by_value
from repeatbuy.plans.staging import stage

by_value(__name__)

SCALE = 256
BUCKET = 4096
BUCKET_BYTES = 16 << 20
BLOCK = 256  # anchors packed together
BLOCKS = 64  # blocks that meet a bucket in one task
FOCUS = 4
SLACK = 1 + 1e-9
STEP = math.log(1.05)  # between levels of length
TASKS = 20_000
LONG = (-(1 << 63), (1 << 63) - 1)
FOUND = "anchor_id long, window int, vec_id long, score long"


def level(length: float) -> int:
    """The step of a logarithmic scale that a length lies on; equal for all up to 1."""
    return 0 if length <= 1 else math.floor(min(math.log(length), 800.0) / STEP)


# --- buckets ---------------------------------------------------------------------------------


def bucket_rows(width: int) -> int:
    return max(64, min(BUCKET, BUCKET_BYTES // (12 * max(width, 1))))


def cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows in pieces of ``rows``, the last one shorter."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        while size >= rows:
            all_rows = pa.Table.from_batches(held)
            yield all_rows.slice(0, rows)
            rest = all_rows.slice(rows)
            held, size = rest.to_batches(), rest.num_rows
    if size:
        yield pa.Table.from_batches(held)


def make_buckets(rows: DataFrame, width: int, n: int) -> DataFrame:
    """bucket, level, longest and body: sorted rows, packed, with a sorted list of each coordinate."""
    per = bucket_rows(width)

    def run(batches):
        for piece in cut(batches, per):
            v, length = matrix(piece["v"], width), piece["length"].to_numpy()
            with np.errstate(invalid="ignore"):
                unit = v / np.where(length > 0, length, 1)[:, None]
            order = np.argsort(unit, axis=0, kind="stable").astype(np.uint16 if per <= 1 << 16 else np.uint32)
            body = pack(
                id=piece["vec_id"].to_numpy(), label=piece["label"].to_numpy(), length=length,
                v=small(v), order=np.ascontiguousarray(order.T),
            )
            yield pa.RecordBatch.from_pydict(
                {"level": pa.array([level(length[0])], pa.int32()), "longest": [length[0]], "body": [body]}
            )

    parts = max(1, min(TASKS, math.ceil(n / per)))
    order = [F.desc("length"), F.col("vec_id")]
    cut_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = cut_rows.mapInArrow(run, "level int, longest double, body binary")
    return made.select(F.monotonically_increasing_id().alias("bucket"), "*")


class Bucket:
    """One packed bucket, and how its rows are pruned and verified."""

    def __init__(self, body: bytes):
        held = unpack(body)
        self.id, self.label, self.length = held["id"], held["label"], held["length"]
        self.v = held["v"].astype(float)
        self.order = held["order"]
        self.most = float(np.abs(self.v).max()) if self.v.size else 0.0
        with np.errstate(invalid="ignore"):
            self.unit = self.v / np.where(self.length > 0, self.length, 1)[:, None]
        self._lists: dict[int, np.ndarray] = {}
        self._labels: dict[int, np.ndarray] = {}

    def values(self, f: int) -> np.ndarray:
        """The sorted list of one coordinate."""
        if f not in self._lists:
            self._lists[f] = self.unit[self.order[f], f]
        return self._lists[f]

    def of_label(self, label: int) -> np.ndarray:
        if label not in self._labels:
            self._labels[label] = np.flatnonzero(self.label == label)
        return self._labels[label]

    def candidates(self, query: np.ndarray, norm: float, bound: float) -> np.ndarray | int:
        """Rows whose product with the query may reach the bound: their places, or the number of
        leading rows where coordinates would leave more than half of these."""
        n = len(self.id)
        reach = norm * self.length[0]
        if bound <= 0 or reach == 0 or not math.isfinite(reach):
            return n if bound <= 0 or reach else 0
        t = bound / reach / SLACK
        if t > 1:
            return 0
        # Rows are sorted by falling length: the product is at most the lengths' product.
        n = int(np.searchsorted(-self.length, -(bound / norm / SLACK), side="right"))
        q = np.clip(query / norm, -1, 1)
        focus = np.argsort(-np.abs(q))[:FOCUS]
        # A vector within the angle acos(t) of the query has each coordinate between the cosines of
        # that coordinate's own angle to the query, less and plus acos(t).
        own, wide = np.arccos(q[focus]), math.acos(min(t, 1.0))
        low = np.where(own + wide >= math.pi, -1.0, np.cos(np.minimum(own + wide, math.pi))) - 1e-9
        high = np.where(own <= wide, 1.0, np.cos(np.maximum(own - wide, 0.0))) + 1e-9
        lists = [self.values(f) for f in focus]
        first = [int(np.searchsorted(x, a)) for x, a in zip(lists, low, strict=True)]
        last = [int(np.searchsorted(x, b, side="right")) for x, b in zip(lists, high, strict=True)]
        best = min(range(len(focus)), key=lambda i: last[i] - first[i])
        if 2 * (last[best] - first[best]) > n:
            return n
        at = np.sort(self.order[focus[best]][first[best] : last[best]].astype(np.int64))
        at = at[at < n]
        for i, f in enumerate(focus):
            if i != best:
                x = self.unit[at, f]
                at = at[(x >= low[i]) & (x <= high[i])]
        return at

    def scores(self, at: np.ndarray | int, query: np.ndarray) -> np.ndarray:
        """Exact integer products, those beyond a long as its ends: through doubles while no sum can
        pass 2**53."""
        rows = self.v[:at] if isinstance(at, int) else self.v[at]
        if self.most * float(np.abs(query).sum()) < 2.0**53:
            return (rows @ query).astype(np.int64)
        exact = whole(rows) @ whole(query)
        return np.array([max(LONG[0], min(LONG[1], x)) for x in exact.tolist()], np.int64)


# --- windows of scores -----------------------------------------------------------------------


def window_ends(score: int | None, low: int, high: int) -> tuple[int | None, int | None]:
    """Scores s with low * score <= 100 * s <= high * score, as whole numbers; no ends without one."""
    return (None, None) if score is None else (-(-low * score // 100), high * score // 100)


def best_in(bucket: Bucket, anchor: dict, same: bool, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window of an anchor the k best of its rows in the bucket that reach its bound."""
    windows = anchor["windows"]
    if not windows:
        return
    bounds = [w["bound"] for w in windows]
    least = -math.inf if None in bounds else min(bounds)
    at = bucket.candidates(anchor["v"], anchor["length"], float(least))
    mine = bucket.of_label(anchor["label"])
    if same:
        at = mine[: np.searchsorted(mine, at)] if isinstance(at, int) else at[bucket.label[at] == anchor["label"]]
    elif not isinstance(at, int):
        at = at[bucket.label[at] != anchor["label"]]
    score = bucket.scores(at, anchor["v"])
    if least > -math.inf:
        near = np.flatnonzero(score >= least)
        at, score = (near if isinstance(at, int) else at[near]), score[near]
    elif isinstance(at, int):
        at = np.arange(at)
    fine = (bucket.id[at] != anchor["id"]) & ((bucket.label[at] == anchor["label"]) == same)
    at, score = at[fine], score[fine]
    for window in windows:
        low, high = window["low"], window["high"]
        low = window["bound"] if window["bound"] is not None else low
        held = np.ones(len(at), bool)
        if low is not None:
            held &= score >= low
        if high is not None:
            held &= score <= high
        place = np.flatnonzero(held)
        if len(place) > k:
            own = score[place]
            place = place[own >= np.partition(own, len(own) - k)[len(own) - k]]
        ids, own = bucket.id[at[place]], score[place]
        best = np.lexsort((ids, ~own))[:k]
        yield window["window"], ids[best], own[best]


def anchors_of(piece: pa.Table, width: int, low: int, high: int) -> list[dict]:
    """Rows anchor_id, label, length, v, windows (window, score, bound), as dictionaries. A window
    that no score can lie in is left out."""
    v = matrix(piece["v"], width)
    out = []
    columns = (piece[c].to_pylist() for c in ("anchor_id", "label", "length", "windows"))
    for i, (own, label, length, windows) in enumerate(zip(*columns, strict=True)):
        held = []
        for w in windows:
            a, b = window_ends(w["score"], low, high)
            if a is None or a <= b:
                held.append(w | {"low": a, "high": b})
        out.append({"id": own, "label": label, "length": length, "v": v[i], "windows": held})
    return out


def with_bounds(anchors: DataFrame, head: bytes, width: int, same: bool, k: int, low: int, high: int) -> DataFrame:
    """Anchors with the bounds that the bucket of the longest vectors gives, and ``need``: the least
    length of a vector that can reach one of them. Anchors without a window are left out."""
    shared = anchors.sparkSession.sparkContext.broadcast(head)
    schema = T.StructType([*anchors.schema.fields, T.StructField("need", T.DoubleType())])

    def run(batches):
        bucket = Bucket(shared.value)
        for batch in batches:
            for piece in cut([batch], BLOCK):
                needs, kept, rows = [], [], []
                for place, anchor in enumerate(anchors_of(piece, width, low, high)):
                    found = {w: (ids, scores) for w, ids, scores in best_in(bucket, anchor, same, k)}
                    held = []
                    for w in anchor["windows"]:
                        scores = found[w["window"]][1]
                        bound = int(min(scores)) if len(scores) == k else w["low"]
                        held.append({"window": w["window"], "score": w["score"], "bound": bound})
                    if held:
                        least = min((-math.inf if w["bound"] is None else w["bound"]) for w in held)
                        needs.append(least / anchor["length"] / SLACK if least > 0 and anchor["length"] > 0 else 0.0)
                        kept.append(place)
                        rows.append(held)
                out = piece.take(pa.array(kept, pa.int64()))
                out = out.set_column(out.schema.get_field_index("windows"), "windows", pa.array(rows, piece.schema.field("windows").type))
                yield from out.append_column("need", pa.array(needs, pa.float64())).combine_chunks().to_batches()

    return anchors.mapInArrow(run, schema)


def make_blocks(anchors: DataFrame, n: int) -> DataFrame:
    """Anchors of like need packed into blocks: the first level of a bucket that a block has to meet,
    and the anchors themselves as an Arrow stream."""

    def run(batches):
        for piece in cut(batches, BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema) as writer:
                writer.write_table(piece)
            least = min(piece["need"].to_pylist())
            yield pa.RecordBatch.from_pydict(
                {"first": pa.array([level(least)], pa.int32()), "anchors": [sink.getvalue().to_pybytes()]}
            )

    parts = max(1, min(TASKS, math.ceil(n / BLOCK)))
    cut_rows = anchors.repartitionByRange(parts, "need", "anchor_id").sortWithinPartitions("need", "anchor_id")
    made = cut_rows.mapInArrow(run, "first int, anchors binary")
    return made.select(F.monotonically_increasing_id().alias("block"), "*")


def meet(blocks: DataFrame, buckets: DataFrame, width: int, same: bool, k: int, low: int, high: int) -> DataFrame:
    """Every block against the buckets whose longest vector reaches what the block needs.

    Blocks and buckets meet by level of length, by a hash of the bucket within its level, and in
    groups of about BLOCKS blocks. On the driver: a count for each level, some ten thousand at most.
    """
    levels = sorted((r[0], r[1]) for r in buckets.groupBy("level").count().collect())
    groups = max(1, math.ceil(blocks.count() / BLOCKS))
    known = F.array(*[F.struct(F.lit(a).alias("level"), F.lit(m).alias("parts")) for a, m in levels])
    reached = F.filter(known, lambda x: x["level"] >= F.col("first"))
    asked = blocks.withColumn("at", F.explode(reached)).select(
        F.col("at.level").alias("level"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("at.parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"),
        "anchors",
    )
    parts = F.element_at(F.create_map(*[F.lit(x) for pair in levels for x in pair]), F.col("level"))
    held = buckets.select(
        "level",
        F.pmod(F.xxhash64("bucket"), parts).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"),
        "body",
    )
    keys = ("level", "part", "group")
    tasks = min(TASKS, max(shuffle_width(blocks.sparkSession), 4 * groups * sum(m for _, m in levels)))

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        for body in held["body"]:
            bucket = Bucket(body)
            for stream in asked["anchors"]:
                for anchor in anchors_of(pa.ipc.open_stream(stream).read_all(), width, low, high):
                    for window, ids, scores in best_in(bucket, anchor, same, k):
                        found += [(anchor["id"], window, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(found, columns=["anchor_id", "window", "vec_id", "score"])

    left = asked.repartition(tasks, *keys).groupBy(*keys)
    right = held.repartition(tasks, *keys).groupBy(*keys)
    return left.cogroup(right).applyInPandas(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(anchors: DataFrame, buckets: DataFrame, head: bytes, width: int, same: bool, k: int, low: int, high: int) -> DataFrame:
    """The k best rows of every window of every anchor: anchor_id, window, vec_id, score, rank."""
    asked = stage(with_bounds(anchors, head, width, same, k, low, high), "anchors")
    blocks = stage(make_blocks(asked, asked.count()), "blocks")
    return ranked(meet(blocks, buckets, width, same, k, low, high), k)


def mine(
    vectors: DataFrame, asked: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale x); a score is an integer inner product, higher first, ties by
    smaller id. An anchor is a row that ``asked`` holds for. Its positives are its best other rows of
    its label, and a positive's negatives the best rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Of
    rows that share an id the one with the smallest label, then vector, stands for all, so a repeated
    row counts once. Vectors of different lengths meet as if padded with zeros. Scores beyond a long
    count as its ends. An anchor or positive without a partner gives no row; an empty table gives
    an empty result. On the driver: counts, and the one bucket of the longest vectors (16 MB at most).
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), scaled("embedding", scale).alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = stage(rows.withColumn("length", F.sqrt(square)), "vectors")
    width, n = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = stage(make_buckets(rows, width, n), "buckets")
    heads = buckets.orderBy(F.desc("longest"), "bucket").limit(1).select("body").collect()
    head = bytes(heads[0][0]) if heads else pack(
        id=np.zeros(0, np.int64), label=np.zeros(0, np.int64), length=np.zeros(0),
        v=np.zeros((0, width), np.int32), order=np.zeros((width, 0), np.uint16),
    )
    if not heads:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )

    anchors = rows.filter(asked).withColumnRenamed("vec_id", "anchor_id")
    one = "array(named_struct('window', 0, 'score', cast(null as bigint), 'bound', cast(null as bigint)))"
    first = search(anchors.withColumn("windows", F.expr(one)), buckets, head, width, True, positives, low, high)
    first = stage(first.drop("window"), "positives")
    # The positives of an anchor, at most ``positives`` of them, are the windows of its second search.
    window = F.struct(F.col("rank").alias("window"), "score", F.lit(None).cast("long").alias("bound"))
    windows = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    second = search(anchors.join(windows, "anchor_id"), buckets, head, width, False, negatives, low, high)
    named = first.select(
        "anchor_id", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return second.join(named, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, e) = 1
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
