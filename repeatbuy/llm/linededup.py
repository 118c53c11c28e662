"""Line deduplication by winnowing over line hashes.

The text's lines that hold a word are hashed. Every window, the fewest lines from some line on that
hold ``min_words`` words together, selects its smallest line hash as fingerprint; a repeated run of
that many words holds a whole window and so shares a fingerprint wherever it stands. Fingerprints
selected at one line only are dropped with their windows. Each window left is keyed alone and with
each extension by following lines; what occurs earlier anywhere is deleted, the first stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repeatbuy.llm.common import WORD
from repeatbuy.plans.staging import stage

MIN_WORDS = 50
NO_ID = -(1 << 63)


def keys(docs: DataFrame) -> DataFrame:
    """The row as a struct with a key: rows alike in id and text count as one document."""
    return docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("version"),
        "text",
    )


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with a word: its document, place, hash without outer blanks, and words."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(
            F.xxhash64(F.btrim(x, F.lit(" \t\r\x0b\x0c"))).alias("h"),
            F.regexp_count(x, F.lit(WORD)).alias("n"),
        ),
    )
    rows = keys(docs).select("id", "version", F.posexplode(lines).alias("pos", "line"))
    rows = rows.select("id", "version", "pos", "line.h", "line.n").filter("n > 0")
    return rows.repartition("id", "version").dropDuplicates(["id", "version", "pos"])


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """One row per window of ``min_words`` words: place, last place, hash of its lines, fingerprint
    with its place, and the lines after the window for extension: those that end less than
    ``min_words`` words after its first line. A longer run without that line is a run itself."""
    doc = Window.partitionBy("id", "version")
    upto = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("end", F.sum("n").over(upto)).withColumn("begin", F.col("end") - F.col("n"))
    ahead = doc.orderBy("end").rangeBetween(1, min_words - 1)
    lines = lines.withColumn("next", F.collect_list(F.struct("h", "pos")).over(ahead))
    frame = doc.orderBy("begin").rangeBetween(0, min_words - 1)
    made = lines.select(
        "id",
        "version",
        "pos",
        "begin",
        F.max("end").over(frame).alias("reach"),
        F.max("pos").over(frame).alias("to"),
        F.min(F.struct("h", "pos")).over(frame).alias("selected"),
        F.collect_list("h").over(frame).alias("seq"),
        "next",
    )
    return made.filter(F.col("reach") - F.col("begin") >= min_words).select(
        "id",
        "version",
        "pos",
        "to",
        F.col("selected.h").alias("fingerprint"),
        F.col("selected.pos").alias("at"),
        F.xxhash64("seq").alias("content"),
        F.filter("next", lambda x: x["pos"] > F.col("to")).alias("tail"),
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, version and places (from, to) of later repeats: each window, alone and extended, whose
    lines were met before, wherever, in the order of (id, version, place). Backwards a match need
    not be walked: the window one line up is then a repeat itself."""
    found = stage(windows(line_rows(docs), min_words), "windows")
    selected = F.struct("id", "version", "at")
    shared = (
        found.groupBy("fingerprint")
        .agg(F.min(selected).alias("first"), F.max(selected).alias("last"))
        .filter("first != last")
        .select("fingerprint")
    )
    runs = F.expr(
        "transform(sequence(0, size(tail)), i -> struct("
        "xxhash64(content, slice(tail.h, 1, i)) as content, if(i = 0, to, get(tail, i - 1).pos) as to))"
    )
    seeds = (
        found.join(shared, "fingerprint", "left_semi")
        .select("id", "version", "pos", F.explode(runs).alias("run"))
        .select("id", "version", "pos", "run.content", "run.to")
    )
    place = F.struct("id", "version", "pos")
    first = (
        seeds.groupBy("content")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter("first != last")
        .select("content", "first")
    )
    return seeds.join(first, "content").filter(place != F.col("first")).select(
        "id", "version", F.col("pos").alias("from"), "to"
    )


def deleted(runs: DataFrame) -> DataFrame:
    """Per document the stretches of lines to keep between its runs, the first line after the last
    run, and how many lines go."""
    doc = Window.partitionBy("id", "version").orderBy("from", "to")
    before = F.coalesce(F.max("to").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = runs.withColumn("before", before)
    new = F.greatest(F.col("to") - F.greatest(F.col("before"), F.col("from") - 1), F.lit(0))
    gap = F.when(
        F.col("from") > F.col("before") + 1,
        F.struct((F.col("before") + 1).alias("at"), (F.col("from") - F.col("before") - 1).alias("n")),
    )
    return (
        runs.select("id", "version", "to", new.alias("gone"), gap.alias("gap"))
        .groupBy("id", "version")
        .agg(
            F.array_sort(F.collect_list("gap")).alias("stay"),
            (F.max("to") + 1).alias("rest"),
            F.sum("gone").alias("gone"),
        )
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row as the struct ``row``, with the new text and the number of lines deleted.

    Lines are parted by \\n and compared without blanks at their ends; lines without a word never
    match but go with a run around them. A run counts from ``min_words`` words on; shorter repeats
    stay. Order is by doc_id (null first) and place, so the smallest id keeps a run. Rows alike in
    id and text are one document and change alike. Null texts stay null; an empty table gives none.
    """
    gone = deleted(repeated_runs(docs, min_words))
    lines = F.split("text", "\n")
    stretches = F.flatten(F.transform("stay", lambda s: F.slice(lines, s["at"] + 1, s["n"])))
    rest = F.slice(lines, F.col("rest") + 1, F.size(lines))
    cut = F.array_join(F.concat(stretches, rest), "\n")
    return (
        keys(docs)
        .join(gone, ["id", "version"], "left")
        .select(
            "row",
            F.when(F.col("rest").isNull(), F.col("text")).otherwise(cut).alias("text"),
            F.coalesce("gone", F.lit(0)).cast("long").alias("n_deleted"),
        )
    )
