"""Canonical order lines and dimensions derived from the star-schema parquet tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatbuy.functions.skew import Sizes, attach

# The fixture's classes stand in for product groups.
FIXTURE_GROUPS = {
    "is_small": ["SMALL"],
    "is_promo": ["PROMO"],
    "is_large": ["LARGE"],
    "is_basic": ["STANDARD", "ECONOMY"],
    "is_mid": ["MEDIUM", "SMALL"],
    "is_cheap": ["ECONOMY", "PROMO"],
    "is_big": ["LARGE", "MEDIUM", "STANDARD"],
}
FIXTURE_LOYAL = ["BUILDING", "MACHINERY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per basket line, in the library's column names."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("bid"),
        F.col("o_custkey").alias("cid"),
        F.col("o_orderdate").alias("checkoutdate"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cid"),
        F.col("c_mktsegment").alias("segmentationlabel"),
        F.col("c_nationkey").alias("marketid"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("iid"),
        F.concat_ws("/", "p_type", "p_brand").alias("catid"),
        F.col("p_type").alias("classid"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("bid"),
        F.col("l_partkey").alias("iid"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )
    newest = orders.agg(F.max("checkoutdate")).scalar()
    days = F.datediff(newest, F.col("checkoutdate"))
    baskets = attach(orders, customers, ["cid"], sizes=Sizes(orders, staged=True))
    sizes = Sizes(lines, staged=True)
    out = attach(lines, baskets.withColumn("days", days), ["bid"], sizes=sizes)
    return attach(out, parts, ["iid"], sizes=sizes).select(
        "cid", "bid", "iid", "catid", "classid", "quantity", "price",
        "segmentationlabel", "marketid", "checkoutdate", "days",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("iid"),
        F.col("p_name").alias("item_name"),
        F.col("p_type").alias("classid"),
        F.concat_ws("/", "p_type", "p_brand").alias("catid"),
        F.col("p_brand").alias("brand_name"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct categories; the name of the first brand is missing, as in real data."""
    cats = items(spark, sf_dir).select("catid", "brand_name").distinct()
    name = F.when(F.col("brand_name") != "Brand#1", F.lower("catid"))
    return cats.select("catid", name.alias("cat_name"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class hierarchy: categories under classes under ROOT, whose parent is NULL."""
    part = items(spark, sf_dir)
    low = part.select(F.col("catid").alias("classid"), F.col("classid").alias("primaryparentid"))
    top = part.select("classid", F.lit("ROOT").alias("primaryparentid"))
    nothing = F.lit(None).cast("string")
    root = part.select(F.lit("ROOT").alias("classid"), nothing.alias("primaryparentid"))
    return (
        low.union(top)
        .union(root)
        .distinct()
        .select("classid", F.lower("classid").alias("class_name"), "primaryparentid")
    )


def write_source_csv(rows: DataFrame, path: str, names: Mapping[str, str]) -> T.StructType:
    """Write rows as CSV with the source's own header, in which names repeat; ``names`` maps numbered
    source names to the columns. The schema to read them with."""
    back = {own: source for source, own in names.items()}
    order = sorted(rows.columns, key=lambda c: list(names.values()).index(c) if c in back else len(names))
    schema = T.StructType()
    for c in order:
        kind = rows.schema[c].dataType
        schema = schema.add(back.get(c, c), T.StringType() if isinstance(kind, T.TimestampType) else kind)
    header = ",".join(re.sub(r"\.\d+$", "", f.name) for f in schema.fields)
    texts = [
        F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if rows.schema[c].dataType == T.TimestampType() else F.col(c)
        for c in order
    ]
    lines = rows.select(F.to_csv(F.struct(*texts)).alias("value"))

    def with_header(frames):
        yield pd.DataFrame({"value": [header]})
        yield from frames

    lines.mapInPandas(with_header, "value string").write.text(path)
    return schema
