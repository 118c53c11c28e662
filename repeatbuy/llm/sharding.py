"""Sharding by histogram sort: splitters are found by counting, then rows move once.

Rows are ordered by (hash of the text, hash of the id), so copies are neighbours and still can be
parted. Each round counts the exact bytes below many candidate borders across all partitions and
narrows the range of every splitter that is not yet within tolerance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repeatbuy.plans.staging import stage

LOW = -(1 << 63)
TOP_BITS = 12
PROBES = 1 << 12
CHUNK_ROWS = 50_000


@dataclass
class Search:
    """Where one splitter may lie: hash values low <= v < high, ``below`` bytes before low. Once
    one text's hash is all that is left (``text``), the search goes on over its ids' hashes."""

    target: float
    low: int = LOW
    high: int = -LOW
    below: int = 0
    text: int | None = None
    found: tuple[int, int] | None = None

    @property
    def range(self) -> tuple:
        return (self.text, self.low, self.high)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two hashes of every row."""
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.xxhash64("text").alias("h"),
        F.xxhash64("doc_id", F.lit("id")).alias("d"),
    )


def step(width: tuple) -> int:
    """Width of a range's cells; the whole range is cut by its upper bits, which can't overflow."""
    _, low, high = width
    return max(1, -(-(high - low) // PROBES))


def cell(width: tuple) -> Column:
    text, low, high = width
    key = F.col("h" if text is None else "d")
    if high - low == 1 << 64:
        at = F.shiftright(key, 64 - TOP_BITS) + F.lit(1 << (TOP_BITS - 1))
    else:
        name = "h" if text is None else "d"
        at = F.expr(f"(`{name}` - cast('{low}' as bigint)) div cast('{step(width)}' as bigint)")
    return at


def inside(width: tuple) -> Column:
    text, low, high = width
    key = F.col("h" if text is None else "d")
    ok = F.lit(True) if text is None else F.col("h") == F.lit(text)
    if low > LOW:
        ok = ok & (key >= F.lit(low))
    if high < -LOW:
        ok = ok & (key < F.lit(high))
    return ok


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys at which a new shard begins. At most shards x PROBES counts come to the driver a round;
    a splitter's range shrinks by PROBES each round, so twelve rounds reach any key."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    searches = [Search(total * k / shards) for k in range(1, shards)]
    near = tolerance * total / shards
    while open_ := [s for s in searches if s.found is None]:
        widths = sorted({s.range for s in open_}, key=str)
        number, at = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, w in enumerate(widths):
            number = F.when(inside(w), i).otherwise(number)
            at = F.when(inside(w), cell(w)).otherwise(at)
        counted = (
            rows.select(number.alias("range"), at.alias("cell"), "size")
            .filter("range is not null")
            .groupBy("range", "cell")
            .agg(F.sum("size").alias("bytes"))
            .collect()
        )
        cells: dict[int, list[tuple[int, int]]] = {}
        for r in counted:
            cells.setdefault(r[0], []).append((r[1], r[2]))
        for s in open_:
            refine(s, sorted(cells.get(widths.index(s.range), [])), near)
    return sorted(s.found for s in searches)


def refine(s: Search, cells: list[tuple[int, int]], near: float) -> None:
    """Take the nearest border if it is near enough, else the cell that holds the target."""
    wide = 1 << (64 - TOP_BITS) if s.high - s.low == 1 << 64 else step(s.range)
    ends = -LOW
    edge = lambda c: min(s.low + c * wide, s.high)
    below, borders = s.below, [(s.below, s.low)]
    hold = None
    for c, size in cells:
        borders.append((below, edge(c)))
        if hold is None and below + size >= s.target:
            hold = (c, below)
        below += size
        borders.append((below, edge(c + 1)))
    best = min(borders, key=lambda b: (abs(b[0] - s.target), b[1]))
    last = s.text is not None and (wide == 1)
    if abs(best[0] - s.target) <= near or last or hold is None:
        value = best[1]
        if s.text is None:
            s.found = (value, LOW) if value < ends else (ends - 1, ends - 1)
        else:
            s.found = (s.text, value) if value < ends else (s.text, ends - 1)
        return
    c, before = hold
    if wide == 1:  # one text's copies hold the target: go on among their ids
        s.text, s.low, s.high, s.below = s.low + c, LOW, -LOW, before
    else:
        s.low, s.high, s.below = edge(c), edge(c + 1), before


def shard_of(cuts: list[tuple[int, int]], h: str = "h", d: str = "d") -> Column:
    shard = F.lit(0)
    for text, row in cuts:
        above = (F.col(h) > F.lit(text)) | ((F.col(h) == F.lit(text)) & (F.col(d) >= F.lit(row)))
        shard = shard + above.cast("int")
    return shard


def assign(docs: DataFrame, shards: int = 16, tolerance: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in a shard, from 0) of every row.

    Bytes of shards are equal to within twice the tolerance, or to one document where documents are
    larger than that. Copies of a text stay together unless a border falls inside a group larger
    than the tolerance. Null texts have size 1 and a null checksum; rows equal in id and text stay
    together; an empty table gives no row.
    """
    rows = stage(keyed(docs), "keys")
    cuts = splitters(rows, shards, tolerance)
    rows = rows.withColumn("shard", shard_of(cuts)).withColumn(
        "part", F.shiftright("h", 64 - TOP_BITS)
    )
    # Slots are counted in pieces of a shard: hash ranges, and where these hold too many rows
    # (a group of copies may), ranges of the ids' hashes inside.
    parts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    fine = parts.select(
        "shard",
        "part",
        F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CHUNK_ROWS))).cast("int").alias("bits"),
    ).filter("bits > 0")
    rows = rows.join(fine, ["shard", "part"], "left")
    rows = rows.withColumn(
        "sub", F.coalesce(F.expr("shiftrightunsigned(d, 64 - bits)"), F.lit(0))
    )
    keys = ["shard", "part", "sub"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part", "sub").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "d", "doc_id")) - 1
    return (
        rows.withColumn("place", place)
        .join(starts, keys)
        .select(
            "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot")
        )
    )


def exchange(docs: DataFrame, path: str, shards: int = 16, tolerance: float = 0.02) -> None:
    """Write all columns of the rows, moved once, in a folder per shard (column ``shard``; a column
    of that name must not exist)."""
    cuts = splitters(stage(keyed(docs), "keys"), shards, tolerance)
    names = {"h": "__hash", "d": "__id"}
    placed = docs.select(
        "*",
        F.xxhash64("text").alias(names["h"]),
        F.xxhash64("doc_id", F.lit("id")).alias(names["d"]),
    ).withColumn("shard", shard_of(cuts, **names))
    placed = placed.drop(*names.values())
    placed.repartition("shard", F.xxhash64("doc_id") % 16).write.partitionBy("shard").parquet(path)
