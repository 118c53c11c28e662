"""Shared pieces: tables, hold-out folds, words, Arrow batches in small slices."""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: A word, wherever a contract speaks of one; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SLICE = 256


def by_value(module: str) -> None:
    """Ship the module's functions to the workers with the task, so that these need no copy of the
    package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int) -> Column:
    """The fold of a row, by the checksum of its id written as text; null without an id."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def map_slices(
    df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, size: int = SLICE
) -> DataFrame:
    """Run a function over small slices of rows: column lists in, column lists out.

    ``make`` is called once in each task and returns that function, so a task can keep caches. Only
    ``size`` rows are Python objects at a time, whatever the size of Spark's Arrow batches.
    """
    fields = _parse_datatype_string(schema)
    assert isinstance(fields, StructType)
    arrow = to_arrow_schema(fields)

    def run(batches):
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                piece = batch.slice(start, size)
                out = step({n: piece.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, fields)


def drawn(by: str, most: int, size: int) -> Column:
    """Whether a row is among about ``most`` of ``size``, by 62 bits of a hash of its id, so that a
    sample keeps its size however many rows there are."""
    bound = min(1 << 62, most * (1 << 62) // max(size, 1))
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(by)), F.lit(1 << 62)) < F.lit(bound)


def bounded_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by``, chosen by a hash of the id; all if there are
    fewer. ``by`` must have few values: one row for each comes to the driver."""
    sizes = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    parts = F.lit(False)
    for value, size in sizes.items():
        parts = parts | ((F.col(by) == F.lit(value)) & drawn(by, most, size))
    return rows.filter(parts)
