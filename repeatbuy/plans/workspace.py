"""Staged tables of one source folder, built once per session and shared by its queries."""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatbuy.functions.fixed import CATEGORY_FEATURES, LABEL
from repeatbuy.functions.skew import Sizes
from repeatbuy.operators import features, holdout, prepare
from repeatbuy.plans import inputs, orders
from repeatbuy.plans.staging import SHORT_SHUFFLES, discard, stage, stage_by_customer
from repeatbuy.sources import fixture

ROW = "row_id"


class Frames(NamedTuple):
    """Scaled train rows, scaled test rows and the balanced training set."""

    train: DataFrame
    test: DataFrame
    balanced: DataFrame
    columns: list[str]

    def vectors(self, name: str) -> DataFrame:
        return prepare.select_features(getattr(self, name), self.columns, [ROW])


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for setting, value in SHORT_SHUFFLES.items():
            spark.conf.set(setting, value)
        self.fitted: dict[str, object] = {}  # models by kind
        self._sizes: dict[str, Sizes] = {}

    @cached_property
    def raw(self) -> DataFrame:
        baskets = fixture.table(self.spark, self.sf_dir, "orders").select(F.col("o_custkey").alias("cid"))
        # Written in between: the shuffles of the joins are gone when the rows are dealt by customer.
        joined = stage(fixture.order_lines(self.spark, self.sf_dir), "joined")
        rows = stage_by_customer(joined, "raw", Sizes(baskets, staged=True))
        discard(joined)
        return rows

    @cached_property
    def item(self) -> orders.Orders:
        return orders.build_orders(orders.item_lines(self.raw), gaps=False)

    @cached_property
    def category(self) -> orders.Orders:
        rolled = orders.staged_rollup(self.raw)
        made = orders.build_orders(orders.popular_lines(rolled, 2, 25, staged=True), gaps=True)
        discard(rolled)
        return made

    def sizes(self, name: str) -> Sizes:
        """Hot keys of a staged line table (raw, item or category), looked up once for all queries."""
        if name not in self._sizes:
            rows = self.raw if name == "raw" else getattr(self, name).lines
            self._sizes[name] = Sizes(rows, staged=True)
        return self._sizes[name]

    @cached_property
    def classes(self) -> DataFrame:
        return fixture.classes(self.spark, self.sf_dir)

    @cached_property
    def holdouts(self) -> dict[int, DataFrame]:
        """Frames of the stacked category input."""
        return inputs.stacked_frames(self.category)

    @cached_property
    def reduced(self) -> DataFrame:
        """Reduced class features of every category."""
        made = features.reduced_class_features(self.raw, "catid", fixture.FIXTURE_GROUPS)
        return stage(made, "reduced")

    @cached_property
    def inputs(self) -> tuple[DataFrame, DataFrame]:
        """Train and test model tables at category grain, with the reduced class features."""
        made = [inputs.model_input_category(self.category, k, self.reduced) for k in (2, 1)]
        train, test = holdout.customer_split(*made)
        named = F.concat_ws("|", "cid", "bid", "catid").alias(ROW)
        keep = [named, "cid", *CATEGORY_FEATURES, LABEL]
        return stage(train.select(*keep), "train"), stage(test.select(*keep), "test")

    @cached_property
    def train_vectors(self) -> DataFrame:
        return self.frames.vectors("balanced")

    @cached_property
    def frames(self) -> Frames:
        train, test = self.inputs
        scale = prepare.standard_scale(train, CATEGORY_FEATURES)
        # Scaling is arithmetic on the row: done on reading, it needs no second copy of the rows.
        train, test = scale.transform(train), scale.transform(test)
        balanced = prepare.smote(train, CATEGORY_FEATURES, ROW)
        return Frames(train, test, balanced, list(CATEGORY_FEATURES))


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The session's workspace of a folder."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, key[1])
    return _OPEN[key]
