"""Repeated strings against a plain scan of all strings of LENGTH bytes."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repeatbuy.llm import queries, suffixdedup

DOCS = "doc_id long, text string, lang string, row string, n int, marks string, spans long, kept long"
SF = "/root/testdata/sf0.001"


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows given in their order."""
    seen, out = set(), []
    for own, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(found):
    """As ``brute``, from the operator's kept bytes and spans."""
    out = []
    for own, size, kept, spans in found.select("doc_id", "n_bytes", "kept", "spans").collect():
        assert all(a < b for a, b in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        out.append((own, size, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "r", 1, "m", 2, 3) for r in rows], DOCS)


def invented(seed, n, letters="abcdefgh  é", pool=12):
    """Texts of random letters with common passages, copies with one changed letter, and long runs."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    common = [word(rng.choice([60, 99, 100, 101, 130, 400])) for _ in range(pool)]
    rows = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.5 else word(rng.randrange(150)) for _ in range(rng.randrange(8))]
        text = "".join(parts)
        if rows and rng.random() < 0.2:
            text = rows[rng.randrange(len(rows))][1]
            if text and rng.random() < 0.5:
                at = rng.randrange(len(text))
                text = text[:at] + "Z" + text[at + 1 :]
        if rng.random() < 0.05:
            text += rng.choice(["x" * 400, "ab" * 300, "abc" * 100])
        rows.append((i, text))
    return rows


def test_odd_rows(spark):
    passage = "".join(random.Random(4).choice("abcdefghij ") for _ in range(150))
    rows = [
        (1, None), (2, ""), (3, "short"), (4, passage), (5, passage[:100]), (6, passage[:99]),
        (7, "é" * 80), (8, "x" + "é" * 80), (9, passage + passage), (10, "x" * 1000), (11, passage[20:] + "!"),
        (11, passage[20:] + "!"), (None, passage), (None, None), (12, "word " * 30_000), (0, "word " * 40),
        (-3, passage[40:145]), ((1 << 63) - 1, "y" * 120),
    ]
    assert digests(suffixdedup.drop_repeats(frame(spark, rows))) == brute(rows)
    empty = suffixdedup.drop_repeats(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "kept", "spans"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_and_copies(spark, seed, monkeypatch):
    rows = invented(seed, 250, "ab" if seed == 3 else "abcdefgh  é")
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    monkeypatch.setattr(suffixdedup, "SLICE", 700)  # long texts in pieces
    monkeypatch.setattr(suffixdedup, "STRETCH", 2000)  # phrases that span stretches
    assert digests(suffixdedup.drop_repeats(frame(spark, shuffled).repartition(5))) == brute(rows)


def test_a_passage_in_every_document(spark):
    """One phrase with an entry of its own in each document, over several partitions."""
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    passage = word(104)
    rows = [(i, word(30) + passage + word(40)) for i in range(600)]
    found = suffixdedup.drop_repeats(frame(spark, rows))
    assert digests(found) == brute(rows)


def test_keys_depend_on_the_string_alone():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 105, 3000).astype(np.uint8)
    twice = np.r_[rng.integers(97, 105, 333).astype(np.uint8), text, text[:50]]

    def per_place(body):
        _, at, n, lead, phrase, _ = suffixdedup.keys(body, np.array([0]), np.array([len(body)]))
        out = np.zeros(len(body), np.int64)
        assert ((lead >= 0) & (lead < 100) & (n < suffixdedup.COUNT)).all()
        for a, m, p in zip(at, n, phrase, strict=True):
            out[a : a + m] = p
        assert sorted(np.concatenate([np.arange(a, a + m) for a, m in zip(at, n, strict=True)])) == list(range(len(body) - 99))
        return out

    assert (per_place(text)[:2901] == per_place(twice)[333 : 333 + 2901]).all()


def test_common_starts():
    got = suffixdedup.common(np.array([1, 1, 1, 2, 2, 3]), [b"ab", b"abc", b"abd", b"abd", b"b", b""])
    assert got.tolist() == [2, 2, 2, 0, 0, 0]


def test_ranks_follow_the_order_of_strings():
    rng = np.random.default_rng(2)
    text = np.r_[rng.integers(97, 99, 400), rng.integers(97, 99, 200), [97] * 300].astype(np.uint8)
    text = np.r_[text, text[:350]]
    rank = suffixdedup.suffix_ranks(text)
    full = text.tobytes()
    strings = [full[i : i + 100] for i in range(len(full) - 99)]
    order = {s: i for i, s in enumerate(sorted(set(strings)))}
    got = {r: i for i, r in enumerate(sorted(set(rank[: len(strings)].tolist())))}
    assert [order[s] for s in strings] == [got[r] for r in rank[: len(strings)].tolist()]


def test_query_over_the_whole_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op12_suffixdedup"](spark, SF)
    got = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept_sha256")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
