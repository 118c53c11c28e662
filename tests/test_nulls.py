"""Rows with unknown keys or chunks stay; large ids are split; ties are settled."""

from pyspark.sql import functions as F

from repeatbuy.functions.skew import ordered
from repeatbuy.operators import clean, explore, holdout


def test_ordered_keeps_null_keys_and_chunks(spark):
    rows = [("a", 1, 1), ("a", None, 2), ("a", 2, 4), (None, 1, 8), (None, 2, 16), ("", 1, 32)]
    df = spark.createDataFrame(rows, "k string, c int, v long")
    out = ordered(df, ["k"], F.col("c"), ["c"], running={"upto": F.col("v")}, prev={"p": F.col("v")})
    got = {r["v"]: (r["upto"], r["p"]) for r in out.collect()}
    assert got == {2: (2, None), 1: (3, 2), 4: (7, 1), 8: (8, None), 16: (24, 8), 32: (32, None)}


def test_customer_bucket_of_large_ids(spark):
    ids = [0, 1, 999, 1_000, 123_456_789, 5 * 10**18, 9_223_372_036_854_775_807]
    df = spark.createDataFrame([(i,) for i in ids], "cid long")
    got = [r[0] for r in df.select(holdout.customer_bucket()).collect()]
    assert got == [(i * 7919 + 104729) % 1000 for i in ids]


def test_parent_name_of_repeated_class(spark):
    rows = [(1, "b", None), (1, "a", None), (2, "c", 1)]
    df = spark.createDataFrame(rows, "classid long, class_name string, primaryparentid long")
    got = {(r["class_name"], r["parent_name"]) for r in clean.parent_name(df).collect()}
    assert got == {("a", None), ("b", None), ("c", "a")}


def test_cart_cost_keeps_customers_without_a_segment(spark):
    rows = [(c, 10 * c + b, 100.0 * (c + b), "A" if c < 4 else None) for c in range(8) for b in range(2)]
    lines = spark.createDataFrame(rows, "cid long, bid long, price double, segmentationlabel string")
    got = {r["segmentationlabel"]: r["customers"] for r in explore.cart_cost_by_segment(lines).collect()}
    assert got == {"A": 4, None: 4}
