"""Written tables that cut lineage between the stages of a job."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from repeatbuy.functions.skew import Sizes, shuffle_width

#: Shuffle files go when the execution that wrote them ends, not when the driver collects garbage.
SHORT_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows hashed by the customer alone are joined by customer and product as they lie.
AS_THEY_LIE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a missing
    setting is an error, since a machine-local folder would vanish with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="repeatbuy-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/repeatbuy/{app}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet and read it back: later steps scan only the columns they use, and a
    lost executor costs a re-read instead of the whole upstream job."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _lies_by(df: DataFrame) -> bool:
    """Whether the planned rows are hashed by ``cid`` alone into as many partitions as a shuffle has."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()
    laid = rf"hashpartitioning\(cid#\d+L?, {shuffle_width(df.sparkSession)}\)"
    return bool(re.fullmatch(laid, plan.outputPartitioning().toString()))


def stage_by_customer(df: DataFrame, name: str, sizes: Sizes) -> DataFrame:
    """As ``stage``, hashed by ``cid``: groups, windows and joins by customer, alone or with more
    columns, read the table without a shuffle. Where ``sizes`` knows of a hot customer or may not look
    for one the rows are left as they come, so that no task holds that customer."""
    spark = df.sparkSession
    if not sizes.plain(["cid"]):
        return stage(df, name)
    with settings(spark, AS_THEY_LIE):
        return _bucketed(by_customer(df), name)


def stage_as_it_lies(df: DataFrame, name: str) -> DataFrame:
    """As ``stage_by_customer``, where the rows are hashed by ``cid`` already."""
    with settings(df.sparkSession, AS_THEY_LIE):
        return _bucketed(df, name) if _lies_by(df) else stage(df, name)


def by_customer(df: DataFrame) -> DataFrame:
    """The rows hashed by ``cid`` as the tables of ``stage_by_customer`` are."""
    return df if _lies_by(df) else df.repartition(shuffle_width(df.sparkSession), "cid")


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = "staged_" + re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    writer = df.write.format("parquet").option("path", path)
    writer.bucketBy(shuffle_width(spark), "cid").sortBy("cid").saveAsTable(table)
    return spark.table(table)


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = staged.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, sort: list[str] | None = None) -> DataFrame:
    """As ``stage``, hashed by ``keys`` into ``buckets`` files, each sorted: later joins, groups and
    windows on these keys read the table without a shuffle. One file a bucket, whatever the number
    of tasks before it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = "staged_" + re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    hashed = df.repartition(buckets, *keys)
    writer = hashed.write.format("parquet").option("path", path).bucketBy(buckets, *keys)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(table)
    return spark.table(table)
