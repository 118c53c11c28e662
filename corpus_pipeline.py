"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and rereads it as the next one's ``docs``. All but the last return the columns of
documents. A null or empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatbuy.llm import linededup, mixing, neardup, pieces, quality
from repeatbuy.llm.common import table
from repeatbuy.plans.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows of an Arrow batch at most: 10,000 long texts are some 30 MB, held by the JVM and by Python for each task.
BATCH = 1000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a thousand at a time; a smaller setting stays."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= BATCH:
        spark.conf.set(BATCH_ROWS, str(BATCH))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled rows here, doesn't reject.

    A document is judged by its text; rows that share an id stay if one of their texts passes."""
    short_batches(spark)
    docs = docs.select(*COLUMNS)
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    worst = scored.groupBy("doc_id").agg(F.max("predicted").alias("predicted"))
    rejected = worst.filter("predicted = 0").select("doc_id")
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["doc_id"]), "left_anti")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeats of runs of lines."""
    found = linededup.drop_repeated_lines(docs.select(*COLUMNS))
    text = F.col("text")
    return found.select(
        "row.doc_id",
        "text",
        "row.lang",
        "row.source",
        F.when(F.col("n_deleted") > 0, F.length(text)).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars"),
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    short_batches(spark)
    docs = docs.select(*COLUMNS)
    found = neardup.near_duplicates(docs)
    gone = found.filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix holds them."""
    found = mixing.mix(docs.select(*COLUMNS)).filter("copies > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return found.select("row", times.alias("copy")).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and whether they decode to the text again."""
    short_batches(spark)
    return pieces.encode(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Hashes and a learned model lie on the way, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
