"""Quality rules: every rule is evaluated once and leaves a bit in a ledger beside its measurements.

A policy is a version with a mask of the rules that reject. Applying another policy, or finding what
each rule alone rejects, reads only the ledger.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatbuy.llm.common import by_value, map_slices

by_value(__name__)

#: Rules in bit order: a document fails a rule where its condition holds.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "2 * n_words > word_chars",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "2 * n_upper > word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Masks by version; a version never changes once it is used.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"] | BIT["repeated_lines"], 3: (1 << len(RULES)) - 1}

SPACE, SYMBOL, UPPER, START = (np.zeros(256, bool) for _ in range(4))
SPACE[[0x20, *range(9, 14)]] = True
SYMBOL[list(b"#*$%&|<>")] = True
UPPER[65:91] = True
START[:] = True
START[0x80:0xC0] = False  # bytes that go on with a character
WINDOW = 5


def repeated_words(found: list[bytes]) -> int:
    """Words inside a window of five words that the text holds twice or more."""
    n = len(found) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found))
    if len(ids) == len(found):
        return 0
    if len(ids) <= 6208:  # five ids fit one number below 2 ** 63
        key = seq[:n].copy()
        for k in range(1, WINDOW):
            key = key * len(ids) + seq[k : k + n]
    else:
        pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]
        four = np.unique(pair[:-2] * (pair.max() + 1) + pair[2:], return_inverse=True)[1]
        key = four[:n] * len(ids) + seq[WINDOW - 1 :]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[at] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(found) + 1, np.int64)
    edge[:n] += again
    edge[WINDOW:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    found = raw.split()
    codes = np.frombuffer(raw, np.uint8)
    lines = Counter(line for line in raw.split(b"\n") if line.strip())
    return (
        len(found),
        int((START[codes] & ~SPACE[codes]).sum()),
        int(SYMBOL[codes].sum()),
        sum(lines.values()) - len(lines),
        repeated_words(found),
        sum(lines.values()),
        int(UPPER[codes].sum()),
    )


MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and the failure bits of every row.

    Null and empty texts measure 0 everywhere; lines without a word are no lines; repeated rows are
    measured each.
    """

    def make():
        def step(cols):
            rows = list(zip(*map(measure, cols["text"]), strict=True)) or [[]] * len(MEASURES)
            return {"doc_id": cols["doc_id"], **dict(zip(MEASURES, map(list, rows), strict=True))}

        return step

    measured = map_slices(
        docs.select(F.col("doc_id").cast("long"), "text"),
        make,
        "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES),
    )
    bits = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits + F.when(F.expr(fails), BIT[name]).otherwise(0)
    return measured.withColumn("failed", bits)


def rejected(version: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(POLICIES[version])) != 0


def apply_policy(rows: DataFrame, version: int) -> DataFrame:
    return rows.withColumn("kept", ~rejected(version))


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents only it rejects; and the bits
    that some, and that all, documents fail. One aggregation of the ledger."""
    mask = POLICIES[version]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    names = [n for n in RULES if BIT[n] & mask]
    totals = rows.select(hit.alias("hit")).agg(
        F.coalesce(F.bit_or("hit"), F.lit(0)).alias("some"),
        F.coalesce(F.bit_and("hit"), F.lit(0)).alias("every"),
        *[F.count_if(F.col("hit").bitwiseAND(F.lit(BIT[n])) != 0).alias(f"f_{n}") for n in names],
        *[F.count_if(F.col("hit") == BIT[n]).alias(f"a_{n}") for n in names],
    )
    each = F.array(
        *[
            F.struct(
                F.lit(n).alias("rule"),
                F.col(f"f_{n}").alias("failing"),
                F.col(f"a_{n}").alias("only_this"),
                (F.col("some").bitwiseAND(F.lit(BIT[n])) != 0).alias("any_document"),
                (F.col("every").bitwiseAND(F.lit(BIT[n])) != 0).alias("all_documents"),
            )
            for n in names
        ]
    )
    return totals.select(F.explode(each).alias("r")).select("r.*")


def judge(docs: DataFrame, version: int = 3) -> DataFrame:
    """The ledger with ``base_failed`` and the verdict ``kept`` of a policy that holds the base."""
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return apply_policy(ledger(docs), version).withColumn("base_failed", base)


SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), flat AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), five AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' ||
         lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
  FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), again AS (
  SELECT doc_id, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS rep
  FROM five
), cover AS (
  SELECT doc_id, max(rep::INT) OVER (PARTITION BY doc_id ORDER BY i
         ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM again
), reps AS (
  SELECT doc_id, sum(c)::BIGINT AS n_repeat_words FROM cover GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN reps USING (doc_id) LEFT JOIN lines USING (doc_id)
), f AS (
  SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
    + 4 * (2 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 16 * (2 * n_words > word_chars)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
    + 64 * (2 * n_upper > word_chars)::BIGINT)::BIGINT AS failed FROM m
)
SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f
"""
