"""Feature tables for every combination of outlier parameters."""

from __future__ import annotations

import time
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.plans.inputs import model_input_stacked
from repeatbuy.plans.orders import build_orders, popular_lines, staged_rollup
from repeatbuy.plans.staging import stage
from repeatbuy.sources.tables import write_features


def parameter_grid(
    raw: DataFrame, path: str, ksigmas: Sequence[float] = (2, 3), otlis: Sequence[int] = (45, 60, 75),
    least_orders: Sequence[int] = (4, 5), min_price: float = 300, rare_class: int = 25,
) -> DataFrame:
    """Write train and test tables of every combination as runs of ``path``; report rows and time.

    The rolled-up lines are shared by all runs, and the enriched lines by all ``ksigmas``.
    """
    spark = raw.sparkSession
    rolled = staged_rollup(raw, min_price)
    report, run = [], 0
    for otli, least in product(otlis, least_orders):
        orders = build_orders(popular_lines(rolled, least, rare_class, staged=True), True, otli)
        for ksigma in ksigmas:
            run += 1
            begun = time.monotonic()
            rows = stage(model_input_stacked(orders, ksigma, otli), "grid")
            for split in ("train", "test"):
                part = rows.filter(F.col("split") == split).drop("split")
                write_features(part, path, str(run), split)
            seconds = time.monotonic() - begun
            report.append((str(run), float(ksigma), otli, least, seconds))
    runs = spark.createDataFrame(
        report, "run string, ksigma double, otli int, least_orders int, seconds double"
    )
    counts = (
        spark.read.parquet(path)
        .groupBy(F.col("run").cast("string").alias("run"))
        .agg(
            F.count_if(F.col("split") == "train").alias("train_rows"),
            F.count_if(F.col("split") == "test").alias("test_rows"),
        )
    )
    return runs.join(counts, "run", "left")

