"""One key with a third of the rows: salted joins and chunked windows equal the plain ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from repeatbuy.functions.skew import Sizes, attach, numbered, ordered


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(3000, numPartitions=6).select(
        F.when(n % 3 == 0, 7).otherwise(n % 400).alias("k"), (n % 50).alias("t"), n.alias("v")
    )


def collected(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_hot_keys_are_few(rows):
    hot = Sizes(rows, floor=0).hot(["k"])
    assert [r["k"] for r in hot.collect()] == [7]
    assert Sizes(rows, staged=True).hot(["k"]) is None
    assert [r["k"] for r in Sizes(rows, staged=True, floor=0).hot(["k"]).collect()] == [7]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("staged", [False, True])
def test_attach_equals_join(rows, how, staged):
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("k") % 2 == 1)
    got = attach(rows, facts, ["k"], how, Sizes(rows, staged, floor=0))
    assert collected(got) == collected(rows.join(facts, "k", how))


def test_attach_spreads_the_hot_key(rows):
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    plan = attach(rows, facts, ["k"], "inner", Sizes(rows, floor=0))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in text
    spread = plan.filter(F.col("k") == 7).hint("no_op").select(F.spark_partition_id().alias("p"))
    plan.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert spread.distinct().count() > 2
    finally:
        plan.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_ordered_equals_window(rows):
    got = ordered(
        rows, ["k"], F.floor(F.col("t") / 7), ["t", "v"],
        running={"place": F.lit(1), "upto": F.col("v")}, total={"n": F.lit(1)},
        prev={"before": F.col("v")}, nxt={"after": F.col("v")},
    )
    w = Window.partitionBy("k").orderBy("t", "v")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*", F.count("*").over(upto).alias("place"), F.sum("v").over(upto).alias("upto"),
        F.count("*").over(Window.partitionBy("k")).alias("n"),
        F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"),
    )
    assert collected(got) == collected(want)


def test_ordered_keeps_null_values(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 6)], "k int, t int, v int")
    got = ordered(rows, ["k"], F.col("t"), ["t"], prev={"before": F.col("v")})
    assert [r["before"] for r in got.orderBy("t").collect()] == [None, 5, None]


def test_ordered_shuffles_the_rows_once(rows):
    base = rows.groupBy("k", "t").agg(F.count("*").alias("n"))
    got = ordered(base, ["k"], F.floor(F.col("t") / 7), ["t"], running={"place": F.col("n")})
    got.collect()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_numbered_is_a_permutation(rows):
    got = [r["_place"] for r in numbered(rows, "v", 3, buckets=16).collect()]
    assert sorted(got) == list(range(1, 3001))


def test_hot_customer_end_to_end(spark, monkeypatch):
    """A customer with a third of all lines: salted and plain builds agree."""
    from repeatbuy.catalog.registry import rounded
    from repeatbuy.functions import skew
    from repeatbuy.operators.clean import category_rollup
    from repeatbuy.plans import inputs
    from repeatbuy.plans.orders import build_orders
    from shop import line, lines

    data = [line(1, 10_000 + b, 2 * b, f"i{(b * j) % 7}", 400 + j) for b in range(100) for j in range(3)]
    data += [
        line(c, 100 * c + b, 30 * b + c % 5, f"i{(c + b * j) % 7}", 500 + j)
        for c in range(2, 32) for b in range(10) for j in range(2)
    ]
    seen = []
    for floor in (skew.HOT_FLOOR, 0):
        monkeypatch.setattr(skew, "HOT_FLOOR", floor)
        rolled = category_rollup(lines(spark, data))
        seen.append(collected(rounded(inputs.model_input_category(build_orders(rolled, True), 1))))
        items = build_orders(lines(spark, data), gaps=False)
        seen.append(collected(rounded(inputs.model_input_item(items, 2))))
    assert seen[0] and seen[0] == seen[2]
    assert seen[1] and seen[1] == seen[3]
