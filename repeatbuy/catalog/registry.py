"""Registration of queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatbuy.plans.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}

# Computed numbers are rounded to millionths, so that the order of a sum does not show. Floor of
# x + 1/2 is plain double arithmetic, so halves come out alike in any engine.
SCALE = 1e6


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.floor(F.col(c) * SCALE + 0.5) / SCALE).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(QUERIES[name](workspace(spark, sf_dir)))

    call.__name__ = name
    return call
