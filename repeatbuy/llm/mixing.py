"""Mixing sources to target weights by weighted sampling without replacement.

Each document draws an exponential key scaled by its quality weight. A source whose target is above
its size first gives whole epochs; the rest of the target is filled with documents in key order up
to the word budget. The budget's place in that order is found by histograms of the key, twice
refined, so rows are only ever numbered inside one narrow cell of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repeatbuy.llm.common import WORD
from repeatbuy.plans.staging import stage

CELLS = 4096
SHARE, CEILING, CYCLE = 1.5, 2.0, (5, 2, 1)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def line_variety(text: str = "text") -> Column:
    """A plain quality weight, 0.5 to 1: half of it falls with the share of repeated lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.lit(0.5) + 0.5 * F.size(F.array_distinct(lines)) / F.size(lines)


def draw(seed: str) -> Column:
    """Uniform in (0, 1), fixed by the document's id (by its text, where it has none)."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(seed), who)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame) -> DataFrame:
    """Adds each source's target words to one row per source (``code``, ``source_size``).

    Weights go by code order, null last. The level at which the sources that stay below their
    ceiling share the rest is the largest that fits, found over sources ordered by ceiling per
    weight. One row per source meets in one task here: sources are names, not documents.
    """
    place = F.row_number().over(Window.orderBy("code")) - 1
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in CYCLE]), (place % len(CYCLE) + 1).cast("int")
    )
    rows = sizes.withColumn("share", weight).withColumn(
        "most", F.col("source_size") * F.lit(CEILING)
    )
    order = Window.orderBy(F.col("most") / F.col("share"), "code")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (
        F.lit(SHARE) * F.sum("source_size").over(whole)
        - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("share").over(after)
    rows = rows.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("share"), F.col("level"))
    rows = rows.withColumn("level", F.max(fits).over(whole))
    return rows.select(
        "code",
        "source_size",
        F.least("most", F.coalesce(F.col("level") * F.col("share"), F.col("most"))).alias("target"),
    )


def mix(docs: DataFrame, weight: Column | None = None, seed: str = "mix") -> DataFrame:
    """Every row as the struct ``row``, with size, source_size, target, copies and taken.

    ``weight`` is a positive quality weight of a row, by default ``line_variety``. Targets are as in
    ``targets``; ``copies`` is how often the mix holds the row and ``taken`` its words in the mix.
    The last document of a budget is taken if that brings the source nearer to its target. Null
    texts have size 0; a null source is one source, last; rows alike in id and text are taken
    alike; an empty table gives none.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"),
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("code"),
        n_words().alias("size"),
        F.pow(draw(seed), F.lit(1.0) / (line_variety() if weight is None else weight)).alias("rank"),
    )
    narrow = stage(rows.select("id", "code", "size", "rank"), "mix")
    away = 1 - F.col("rank")  # the exponential key falls as the rank rises
    first = F.least(F.floor(away * CELLS), F.lit(CELLS - 1))
    second = F.floor((away * CELLS - F.floor(away * CELLS)) * CELLS)
    narrow = narrow.select("*", first.alias("b1"), second.alias("b2"))

    by_cell = narrow.groupBy("code", "b1").agg(F.sum("size").alias("words"))
    goals = targets(by_cell.groupBy("code").agg(F.sum("words").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    goals = goals.withColumn("epochs", F.coalesce(whole, F.lit(0)).cast("long")).withColumn(
        "budget", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    goals = stage(goals, "goals")

    def crossing(cells: DataFrame, budgets: DataFrame, cell: str) -> DataFrame:
        """Per source the first cell in which the running sum reaches the budget, and the budget
        that is left there."""
        run = Window.partitionBy("code").orderBy(cell)
        cells = cells.withColumn("upto", F.sum("words").over(run)).join(budgets, "code")
        return (
            cells.filter("upto >= budget")
            .groupBy("code")
            .agg(F.min_by(F.struct(cell, F.expr("budget - upto + words").alias("left")), cell).alias("c"))
            .select("code", f"c.{cell}", F.col("c.left").alias("budget"))
        )

    one = crossing(by_cell, goals.select("code", "budget"), "b1")
    inside = narrow.join(one, ["code", "b1"])
    two = crossing(
        inside.groupBy("code", "b2").agg(F.sum("size").alias("words")),
        one.select("code", "budget"),
        "b2",
    )
    cell = inside.drop("budget").join(two, ["code", "b2"])
    run = Window.partitionBy("code").orderBy(F.desc("rank"), "id")
    cell = cell.withColumn(
        "middle",
        F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2,
    )
    last = (
        cell.filter("middle <= budget and size > 0")
        .groupBy("code")
        .agg(F.min(F.struct("rank", (-F.col("id")).alias("id"))).alias("last"))
    )
    cut = goals.join(one.select("code", F.col("b1").alias("c1")), "code", "left")
    cut = cut.join(two.select("code", F.col("b2").alias("c2")), "code", "left")
    cut = stage(cut.join(last, "code", "left"), "cuts")

    here = rows.select("*", first.alias("b1"), second.alias("b2")).join(cut, "code")
    early = (F.col("b1") < F.col("c1")) | (
        (F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2"))
    )
    within = (
        (F.col("b1") == F.col("c1"))
        & (F.col("b2") == F.col("c2"))
        & (F.struct("rank", (-F.col("id")).alias("id")) >= F.col("last"))
    )
    chosen = F.coalesce((F.col("budget") > 0) & (early | within), F.lit(False))
    copies = F.col("epochs") + chosen.cast("long")
    return here.select(
        "row",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"),
        F.when(F.col("size") > 0, copies * F.col("size")).otherwise(0).alias("taken"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS code,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         0.5 + 0.5 * len(list_distinct(string_split(coalesce(text, ''), chr(10))))
             / len(string_split(coalesce(text, ''), chr(10))) AS weight,
         (('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
  FROM documents
), s AS (
  SELECT code, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY code) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS share
  FROM d GROUP BY code
), l AS (
  SELECT *, 2.0 * source_size AS most,
         (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (
            ORDER BY 2.0 * source_size / share, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(share) OVER (ORDER BY 2.0 * source_size / share, code
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s
), t AS (
  SELECT code, source_size, least(most, share * (SELECT max(lev) FROM l WHERE lev <= most / share)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), r AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
         sum(size) OVER (PARTITION BY code ORDER BY pow(u, 1.0 / weight) DESC, doc_id
           ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
  FROM d JOIN e USING (code)
)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (size * (epochs + (budget > 0 AND middle <= budget)::INT))::BIGINT AS taken FROM r
"""
