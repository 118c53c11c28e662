"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double; NULL when b is 0 or either side is NULL."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(df: DataFrame, within: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Lines of (within + by) divided by lines of within.

    Use it only where ``by`` has few values per key (weekday, whole-day gap): the window sees one
    pre-aggregated row per value, never the lines.
    """
    w = Window.partitionBy(*within)
    return (
        df.groupBy(*within, *by)
        .agg(F.count("*").alias("_n"))
        .select(*within, *by, ratio(F.col("_n"), F.sum("_n").over(w)).alias(name))
    )


def zero_to_one(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace 0 by 1 in interval columns that later become divisors."""
    return df.withColumns({c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c)) for c in columns})
