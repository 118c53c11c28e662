"""Exact top-k search by inner product over buckets of vectors of like length.

Vectors are ordered by length and cut into buckets. A query's k-th best score in the bucket of the
longest vectors is a bound no answer falls below. Against a bucket, the bound becomes a threshold on
the cosine: above 1 the bucket is skipped; near 1 a vector is pruned by its coordinates (where the
query is large, a vector of that cosine can't be far off); else by its length alone. What is left is
verified by exact integer products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repeatbuy.llm.common import by_value
from repeatbuy.plans.staging import stage

by_value(__name__)

K = 5
BUCKET = 4096
MAX_BUCKETS = 1 << 16
QUERIES = 1024  # of a block
FOCUS = 4
BY_COORDINATE = 0.85
SLACK = 1 + 1e-9
LIMIT = float(1 << 31)


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, vector of floor(scale x) and its length; see ``search`` for rows left out."""
    x = F.col("embedding")
    scaled = F.transform(x, lambda v: v.cast("double") * scale)
    fine = F.forall(scaled, lambda v: F.coalesce(F.abs(v) < LIMIT, F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(fine, scaled).alias("v"))
    rows = rows.filter("v is not null and vec_id is not null").select(
        "vec_id", F.transform("v", lambda v: F.floor(v)).alias("v")
    )
    square = F.aggregate("v", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return rows.dropDuplicates().withColumn("length", F.sqrt(square))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer products; through doubles while no sum can pass 2 ** 53."""
    if len(vectors) and float(np.abs(vectors).max()) * float(np.abs(query).sum()) < 2**53:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return vectors @ query


def survivors(
    unit: np.ndarray, lengths: np.ndarray, query: np.ndarray, norm: float, bound: float
) -> np.ndarray:
    """Places of vectors (by falling length) whose product with the query may reach the bound."""
    if bound <= 0 or norm == 0:
        return np.arange(len(lengths))
    threshold = bound / (norm * lengths[0]) / SLACK if lengths[0] > 0 else math.inf
    if threshold > 1:
        return np.zeros(0, np.int64)
    long_enough = np.searchsorted(-lengths, -(bound / norm / SLACK), side="right")
    if threshold < BY_COORDINATE:
        return np.arange(long_enough)
    # cos(q, p) >= t holds coordinate f of p within q_f t +- sqrt((1 - q_f^2)(1 - t^2)).
    q = query / norm
    keep = np.ones(long_enough, bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        off = math.sqrt(max(0.0, 1 - q[f] ** 2) * max(0.0, 1 - threshold**2)) + 1e-9
        c = unit[:long_enough, f]
        if q[f] >= 0:
            keep &= c >= q[f] * threshold - off
        else:
            keep &= c <= q[f] * threshold + off
    return np.flatnonzero(keep)


def bucket_top(queries: pd.DataFrame, bucket: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one bucket for each query of one block, as far as they reach its bound."""
    empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
    if not len(queries) or not len(bucket):
        return empty
    bucket = bucket.sort_values(["length", "vec_id"], ascending=[False, True])
    width = max(max(map(len, bucket["v"])), max(map(len, queries["v"])), 1)
    vectors, asked = matrix(bucket["v"], width), matrix(queries["v"], width)
    lengths = bucket["length"].to_numpy()
    unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
    ids = bucket["vec_id"].to_numpy()
    out = []
    rows = zip(queries["vec_id"], queries["length"], queries["bound"], asked, strict=True)
    for own, norm, bound, query in rows:
        at = survivors(unit, lengths, query, norm, -math.inf if pd.isna(bound) else float(bound))
        at = at[ids[at] != own]
        if not len(at):
            continue
        score = products(vectors[at], query)
        if len(at) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            near = score >= edge
            at, score = at[near], score[near]
        best = np.lexsort((ids[at], -score))[:k]
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at][best], "score": score[best]}))
    return pd.concat(out) if out else empty


def blockwise(queries: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """Every (block, bucket) row pair of queries against the bucket's vectors."""

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return bucket_top(q, b, k)

    keys = ("block", "bucket")
    return (
        queries.groupBy(*keys)
        .cogroup(buckets.groupBy(*keys))
        .applyInPandas(run, "query_id long, vec_id long, score long")
    )


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k best integer products for each row that ``asked``
    holds for, over all rows with another id; ties to the smaller id, fewer if there are fewer.

    Null vectors or ids, vectors with a null or non-finite component or one beyond 2**31 / 256, take
    no part. Vectors of different lengths meet as if padded with zeros. A repeated row counts once.
    On the driver: a count, and one length for each of at most MAX_BUCKETS buckets.
    """
    rows = stage(whole_vectors(vectors), "vectors")
    n = rows.count()
    buckets = min(MAX_BUCKETS, max(1, math.ceil(n / BUCKET)))
    cut = rows.repartitionByRange(buckets, F.desc("length"), "vec_id")
    cut = stage(cut.withColumn("bucket", F.spark_partition_id()), "buckets")
    tops = {r[0]: r[1] for r in cut.groupBy("bucket").agg(F.max("length")).collect()}
    if not tops:
        return ranked(
            rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")), k
        ).select("query_id", "rank", "vec_id", "score")
    queries = cut.filter(asked).select("vec_id", "v", "length")
    blocks = max(1, math.ceil(queries.count() / QUERIES))

    # The longest vectors bound every query from below.
    longest = max(tops, key=tops.get)
    first = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    first = first.withColumns({"bucket": F.lit(longest), "bound": F.lit(None).cast("double")})
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    head = cut.filter(F.col("bucket") == longest).withColumn("block", F.explode(every))
    bounds = (
        ranked(blockwise(first, head, k), k)
        .groupBy("query_id")
        .agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n"))
        .select(F.col("query_id").alias("vec_id"), F.expr(f"if(n = {k}, cast(bound as double), null)").alias("bound"))
    )
    # Blocks of queries that need vectors of like length at least: bound / length of the query.
    queries = stage(queries.join(bounds, "vec_id", "left"), "queries")
    need = F.when((F.col("bound") > 0) & (F.col("length") > 0), F.col("bound") / F.col("length"))
    need = F.coalesce(need, F.lit(0.0))
    queries = queries.withColumn("need", need).repartitionByRange(blocks, "need", "vec_id")
    queries = stage(queries.withColumn("block", F.spark_partition_id().cast("long")), "blocks")
    least = {r[0]: r[1] for r in queries.groupBy("block").agg(F.min("need")).collect()}
    # Buckets are numbered by falling length and blocks by rising need, so a block visits buckets
    # up to one, and a bucket is visited by blocks up to one: one row for each of them.
    spark = vectors.sparkSession
    upto = [(int(b), max([c for c in tops if tops[c] * SLACK >= low], default=-1)) for b, low in least.items()]
    down = [(c, max([int(b) for b, low in least.items() if tops[c] * SLACK >= low], default=-1)) for c in tops]

    def visits(frame: DataFrame, own: str, other: str, rows: list, kind: str) -> DataFrame:
        last = spark.createDataFrame(rows, f"{own} {kind}, last int").filter("last >= 0")
        joined = frame.join(last, own)
        return joined.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")

    asked_rows = visits(queries, "block", "bucket", upto, "long")
    held_rows = visits(cut, "bucket", "block", down, "int")
    held_rows = held_rows.withColumn("block", F.col("block").cast("long"))
    found = blockwise(asked_rows, held_rows, k)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
WHERE rank <= 5
"""
