"""Keyed joins and ordered windows that stay balanced when one key holds a large share of the rows.

Two ideas cover every operator of the library:

* ``attach`` joins a per-key summary onto rows. Keys that hold more than a fair task's share of
  the rows are found first and spread over several salts; there can be at most
  ``spark.sql.shuffle.partitions`` such keys, so the table of them may be broadcast.
* ``ordered`` computes running sums, previous / next values and totals per key without ever
  putting a whole key into one task. Rows are first summarised per (key, chunk); the window over
  a key runs on one row per chunk, and the window over rows runs inside a chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys below this many rows are never salted: one task handles them without strain.
HOT_FLOOR = 1_000_000


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions, the yardstick for a task's fair share of rows."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Sizes:
    """Hot keys of a row set, for any combination of key columns.

    A key is hot when it holds more than 1/width of the rows, so there are fewer than width of
    them. ``staged=True`` says that ``rows`` is a written table: the few hot keys are then looked
    up at once (a count over the key columns), and where there are none no salting is planned.
    Otherwise the lookup stays part of the lazy plan.
    """

    def __init__(self, rows: DataFrame, staged: bool = False, floor: int | None = None):
        self.rows = rows
        self.staged = staged
        self.floor = HOT_FLOOR if floor is None else floor
        self._hot: dict[tuple[str, ...], DataFrame | None] = {}
        self._small: bool | None = None

    def hot(self, on: Sequence[str]) -> DataFrame | None:
        """The hot keys, or None when there are known to be none."""
        if self.staged:
            if self._small is None:
                self._small = self.rows.count() <= self.floor
            if self._small:
                return None
            # A combination can only be hot where each of its columns is.
            if len(on) > 1 and any(self.hot([c]) is None for c in on):
                return None
        key = tuple(on)
        if key not in self._hot:
            found = self._lookup(key)
            if self.staged:
                keys = found.collect()  # fewer than width rows
                spark = self.rows.sparkSession
                found = spark.createDataFrame(keys, found.schema) if keys else None
            self._hot[key] = found
        return self._hot[key]

    def plain(self, on: Sequence[str]) -> bool:
        """Whether it is known that no key is hot."""
        return self.staged and self.hot(on) is None

    def _lookup(self, on: tuple[str, ...]) -> DataFrame:
        width = shuffle_width(self.rows.sparkSession)
        fair = self.rows.agg(
            F.greatest(F.count("*") / F.lit(width), F.lit(float(self.floor)))
        ).scalar()
        return (
            self.rows.groupBy(*on)
            .agg(F.count("*").alias("_rows"))
            .filter(F.col("_rows") > fair)
            .select(*on, F.lit(True).alias("_hot"))
        )


def attach(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    sizes: Sizes | None = None,
) -> DataFrame:
    """Join ``right`` (unique per key) onto ``left``, spreading the hot keys of ``left``.

    ``how`` is any of inner, left, left_semi, left_anti. Row results equal the plain join.
    ``sizes`` names the table whose key counts decide which keys are hot (default: ``left``).
    """
    on = list(on)
    hot = (sizes or Sizes(left)).hot(on)
    if hot is None:
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    width = shuffle_width(left.sparkSession)
    salt = F.pmod(F.xxhash64(*left.columns) + F.spark_partition_id(), F.lit(width)).cast("int")
    rows = (
        left.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(width - 1))).otherwise(
        F.array(F.lit(0))
    )
    facts = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return rows.join(facts, [*on, "_salt"], how).drop("_salt")


def filled(df: DataFrame, name: str) -> Column:
    """The column with a value of its type in place of NULL."""
    kind = df.schema[name].dataType.simpleString()
    value = "1970-01-01" if kind.startswith(("date", "timestamp")) else "0"
    return F.coalesce(F.col(name), F.lit(value).cast(kind))


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    *,
    running: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    nxt: Mapping[str, Column] | None = None,
    sizes: Sizes | None = None,
) -> DataFrame:
    """Add ordered per-key values to every row, exactly, without a task per key.

    ``chunk`` must not decrease along ``order`` within a key (an hour of a timestamp, a block of
    order numbers). ``running`` are inclusive running sums, ``total`` sums over the whole key,
    ``prev`` / ``nxt`` the value on the neighbouring row, NULL at the ends. Rows whose key is NULL
    are a key of their own, and a NULL chunk comes first. Where ``sizes`` knows of no hot key the rows
    of a key fit a task, and plain windows do.
    """
    running, total, prev, nxt = (dict(m or {}) for m in (running, total, prev, nxt))
    if keys and sizes is not None and sizes.plain(keys):
        along = Window.partitionBy(*keys).orderBy(*order)
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = [F.col(c) for c in df.columns]
        out += [F.sum(c).over(upto).alias(n) for n, c in running.items()]
        out += [F.sum(c).over(Window.partitionBy(*keys)).alias(n) for n, c in total.items()]
        out += [F.lag(c).over(along).alias(n) for n, c in prev.items()]
        return df.select(*out, *[F.lead(c).over(along).alias(n) for n, c in nxt.items()])
    rank = F.struct(*order)
    # Rows and their summary are joined on keys and chunk. Filled values and a count of what is
    # known stand for them, so that NULLs meet and both sides shuffle alike, once.
    plain, keys = list(keys), [f"_key_{i}" for i in range(len(keys))]
    rows = df.withColumn("_chunk", chunk)
    known = sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(plain)), F.lit(0))
    rows = rows.withColumns(
        {k: filled(rows, c) for k, c in zip(keys, plain, strict=True)}
        | {"_known": known, "_placed": F.col("_chunk").isNotNull().cast("int")}
    ).withColumn("_chunk", filled(rows, "_chunk"))
    if keys:
        keys = [*keys, "_known"]

    summary = [F.sum(c).alias(f"_sum_{n}") for n, c in {**total, **running}.items()]
    if prev:
        last = F.struct(*[c.alias(n) for n, c in prev.items()])
        summary.append(F.max_by(last, rank).alias("_last"))
    if nxt:
        first = F.struct(*[c.alias(n) for n, c in nxt.items()])
        summary.append(F.min_by(first, rank).alias("_first"))
    pieces = rows.groupBy(*keys, "_placed", "_chunk").agg(*summary)

    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_placed", "_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = [
        F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}")
        for n in running
    ]
    heads += [F.sum(f"_sum_{n}").over(whole).alias(n) for n in total]
    if prev:
        heads.append(F.lag("_last").over(along).alias("_prev"))
    if nxt:
        heads.append(F.lead("_first").over(along).alias("_next"))
    joined = rows.join(
        pieces.select(*keys, "_placed", "_chunk", *heads), [*keys, "_placed", "_chunk"], "inner"
    )

    inside = Window.partitionBy(*keys, "_placed", "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [F.col(c) for c in df.columns]
    out += [(F.col(f"_before_{n}") + F.sum(c).over(upto)).alias(n) for n, c in running.items()]
    out += [F.col(n) for n in total]
    if prev:
        here = F.struct(*[c.alias(n) for n, c in prev.items()])
        back = F.coalesce(F.lag(here).over(inside), F.col("_prev"))
        out += [back[n].alias(n) for n in prev]
    if nxt:
        here = F.struct(*[c.alias(n) for n, c in nxt.items()])
        ahead = F.coalesce(F.lead(here).over(inside), F.col("_next"))
        out += [ahead[n].alias(n) for n in nxt]
    return joined.select(*out)


def numbered(
    rows: DataFrame, key: str, seed: int, name: str = "_place", buckets: int = 65536
) -> DataFrame:
    """Number the rows from 1 in a seeded hash order of ``key``, bucket by bucket."""
    mixed = rows.withColumn("_mix", F.xxhash64(F.lit(seed), F.col(key)))
    mixed = mixed.withColumn("_bucket", F.pmod(F.col("_mix"), F.lit(buckets)))
    return ordered(
        mixed, [], F.col("_bucket"), ["_bucket", "_mix", key], running={name: F.lit(1)}
    ).drop("_mix", "_bucket")
