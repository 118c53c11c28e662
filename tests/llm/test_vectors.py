"""Hard negatives and vector codes against brute force and SQL."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from repeatbuy.llm import arrays, codes, hardneg, queries

VECTORS = "vec_id long, embedding array<double>, label long, length double, row string, score long, code string, error long"
SF = "/root/testdata/sf0.01"
INF = float("inf")
#: Null ids, vectors, components and labels, vectors that aren't finite, short and empty ones, repeated
#: rows, rows that share an id, zeros, ties, and components that no machine word holds squared.
ODD = [
    (0, [0.5, 0.25, 0.125], 1),
    (0, [0.5, 0.25, 0.125], 1),
    (100, [0.9, 0.1], 1),
    (100, [0.1, 0.9], 1),
    (200, [1e30, 2e30, -1e30], 1),
    (300, [], 2),
    (400, [3e5, -9e6, 2e7], 2),
    (1, [0.5, 0.25, 0.125], 1),
    (2, [0.5, 0.25, 0.125], 2),
    (3, [0.5, 0.25, 0.1], 2),
    (4, [0.25, 0.125, 0.0625], 2),
    (5, [0.0, 0.0, 0.0], 1),
    (6, [1e30, 2e30, -0.9e30], 1),
    (7, [4e29, 9e29, -5e29], 2),
    (8, [1e5, -5e6, 1e7], 1),
    (9, None, 1),
    (10, [None, 1.0], 1),
    (11, [float("nan"), 1.0], 2),
    (12, [INF, 1.0], 2),
    (13, [0.1, 0.2, 0.3], None),
    (None, [0.4, 0.3, 0.2], 2),
    (None, None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "r", 2, "c", 3) for r in rows], VECTORS)


def clean(rows, scale, named):
    """Rows that take part, as whole numbers of arbitrary size, padded alike."""
    out = []
    for own, v, label in rows:
        if v is None or (named and (own is None or label is None)):
            continue
        if all(x is not None and abs(x) < INF for x in v):
            out.append((own, [int(np.floor(x * scale)) for x in v], label))
    width = max((len(v) for _, v, _ in out), default=0)
    return [(own, v + [0] * (width - len(v)), label) for own, v, label in out]


# --- hard negatives --------------------------------------------------------------------------


def long(score):
    return max(hardneg.LONG[0], min(hardneg.LONG[1], score))


def brute_negatives(rows, every=100, positives=5, negatives=10):
    held = {}
    for own, v, label in sorted(clean(rows, 256, True), key=lambda r: (r[0], r[2], r[1])):
        held.setdefault(own, (v, label))
    out = set()
    for anchor, (v, label) in held.items():
        if anchor % every:
            continue
        score = {i: long(sum(a * b for a, b in zip(v, w, strict=True))) for i, (w, _) in held.items()}
        order = sorted(score, key=lambda i: (-score[i], i))
        best = [i for i in order if i != anchor and held[i][1] == label][:positives]
        for p in best:
            fine = [i for i in order if held[i][1] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            for rank, i in enumerate(fine[:negatives], 1):
                out.add((anchor, p, rank, i, score[p], score[i]))
    return out


def mined(df, **rest):
    found = [tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 100 == 0, **rest).collect()]
    assert len(set(found)) == len(found)
    return set(found)


def test_negatives_of_odd_rows(spark):
    want = brute_negatives(ODD)
    assert mined(frame(spark, ODD)) == want and len(want) > 5
    assert mined(frame(spark, ODD[:1])) == set()
    empty = hardneg.mine(frame(spark, []), F.col("vec_id") % 100 == 0)
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def clusters(seed, n, width=12):
    """Vectors around a few directions, of very different lengths, with copies and ties."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, width))
    rows = []
    for i in range(n):
        v = middle[rng.integers(8)] + rng.normal(size=width) * 0.2
        v = v / np.linalg.norm(v) * 2.0 ** rng.integers(-3, 6)
        rows.append((i, [float(x) for x in v], int(rng.integers(4))))
    hot = rows[7][1]
    return rows + [(n + i, hot, i % 3) for i in range(n // 2)]


def test_negatives_over_many_buckets(spark, monkeypatch):
    rows = clusters(1, 3000)
    monkeypatch.setattr(hardneg, "BUCKET", 64)
    monkeypatch.setattr(hardneg, "BLOCK", 4)
    monkeypatch.setattr(hardneg, "BLOCKS", 2)
    assert mined(frame(spark, rows)) == brute_negatives(rows)


def test_candidates_hold_every_row_that_reaches_the_bound():
    rng = np.random.default_rng(3)
    pruned = 0
    for _ in range(200):
        width, n = int(rng.integers(1, 10)), 200
        v = np.floor(rng.normal(size=(n, width)) * 2.0 ** rng.integers(0, 12, n)[:, None])
        length = np.sqrt((v**2).sum(1))
        sort = np.argsort(-length, kind="stable")
        v, length = v[sort], length[sort]
        unit = v / np.where(length > 0, length, 1)[:, None]
        order = np.argsort(unit, axis=0).T
        bucket = hardneg.Bucket(arrays.pack(id=np.arange(n), label=np.zeros(n, int), length=length, v=v, order=order))
        query = np.floor(rng.normal(size=width) * 100)
        score = v @ query
        bound = float(np.sort(score)[-int(rng.integers(1, 40))])
        at = bucket.candidates(query, float(np.sqrt((query**2).sum())), bound)
        at = np.arange(at) if isinstance(at, int) else at
        assert set(np.flatnonzero(score >= bound)) <= set(at.tolist())
        pruned += len(at) < n
    assert pruned > 100


# --- vector codes ----------------------------------------------------------------------------


def brute_codes(rows):
    """(vec_id, label) -> code, error and label error, by plain Lloyd in Python integers."""
    held = clean(rows, 4096, False)
    d = max(1, -(-max((len(v) for _, v, _ in held), default=0) // 8))
    parts = [[(v + [0] * 8 * d)[p * d : (p + 1) * d] for p in range(8)] for _, v, _ in held]
    first = {}
    for (own, v, _), x in sorted(zip(held, parts, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[0][1])):
        if own is not None:
            first.setdefault(own, x)
    books = [[x[p] for x in list(first.values())[:16]] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(6):
        for p in range(8):
            own = [nearest(x[p], books[p])[1] for x in parts]
            for e in range(len(books[p])):
                mine = [x[p] for x, at in zip(parts, own, strict=True) if at == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for (own, _, label), x in zip(held, parts, strict=True):
        best = [nearest(x[p], books[p]) for p in range(8)]
        out.append((own, label, "".join(f"{e:02x}" for _, e in best), sum(s for s, _ in best)))
    total = {}
    for _, label, _, error in out:
        total[label] = total.get(label, 0) + min(codes.MOST, error)
    rows = sorted(((*r[:3], min(codes.MOST, r[3]), min(codes.MOST, total[r[1]])) for r in out), key=str)
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return rows, hashlib.sha256(text.encode()).hexdigest()


def encoded(df):
    found, books = codes.encode(df)
    return sorted(map(tuple, found.collect()), key=str), codes.digest(books)


def test_codes_of_odd_rows(spark):
    assert encoded(frame(spark, ODD)) == brute_codes(ODD)
    few = [(1, [], 1), (2, [], None), (None, [], None)]
    assert encoded(frame(spark, few)) == brute_codes(few)
    nameless = [(None, [1.0], 1)]
    for rows in ([], nameless, [(1, None, 1)]):
        found, books = codes.encode(frame(spark, rows))
        assert found.collect() == [] and books.shape[1] == 0
        assert found.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_codes_over_many_pieces(spark, monkeypatch):
    rows = clusters(2, 1500, 16)
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(codes, "PIECE", 128)
    want = brute_codes(rows)
    assert encoded(frame(spark, rows).repartition(7)) == want
    assert encoded(frame(spark, rows).coalesce(1)) == want


def test_trees_cover_and_part():
    """Children lie within reach of their node and apart from one another; ranges nest; radii hold."""
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(size=(8 * 500, 3)) * 50)
    tree = codes.grow(points, 8)
    assert sorted(tree["order"]) == list(range(len(points)))
    for at in range(len(tree["start"])):
        start, stop, centre, radius = (tree[c][at] for c in ("start", "stop", "centre", "radius"))
        below = points[tree["order"][start:stop]]
        assert np.sqrt(((below - points[centre]) ** 2).sum(1)).max() == pytest.approx(radius)
        first, count = tree["child"][at], tree["children"][at]
        if count:
            kids = np.arange(first, first + count)
            assert list(tree["stop"][kids][:-1]) == list(tree["start"][kids][1:])
            assert tree["start"][kids[0]] == start and tree["stop"][kids[-1]] == stop
            reach = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            assert (tree["radius"][kids] <= reach).all() and tree["centre"][kids[0]] == centre
            own = points[tree["centre"][kids]]
            gap = np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1))
            assert (gap[~np.eye(count, dtype=bool)] > reach).all()


def test_walk_hands_over_whole_subtrees():
    """Far apart groups go to their entries without a look at their rows."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(16, 2)) * 1e6
    points = np.floor(np.tile(middle[rng.integers(16, size=1000)] + rng.normal(size=(1000, 2)), (8, 1)))
    tree = codes.grow(points, 8)
    back = np.empty(len(points), np.int64)
    back[tree["order"]] = np.arange(len(points))
    tree |= {"points": points[tree["order"]].astype(np.int32), "centre": back[tree["centre"]]}
    books = np.array(np.tile(np.floor(middle), (8, 1, 1)).astype(np.int64).tolist(), object)
    start, stop, _ = codes.nearest(tree, books)
    assert (stop - start).sum() == len(points) and len(start) < len(points) / 10


@pytest.mark.parametrize("name", ["op11_hardneg", "op13_codes"])
def test_equals_sql(spark, name):
    assert difference(connect(SF), queries.SQL[name], queries.QUERIES[name](spark, SF)) == ""
