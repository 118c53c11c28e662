"""Codes for vectors by product quantisation, with codebooks learned through cover trees.

Vectors are cut into parts, and every part position has a codebook. Rows are taken in pieces as they
lie in their partition; each piece gets one cover tree for each part position, whose nodes hold a
point of the piece, the radius around it and a range of the tree's row order. Cumulative sums over
that order give the sum of any subtree. A round of Lloyd's algorithm walks down the trees: an entry
that is further from a node's point than the nearest one by more than twice the radius can't be
nearest to any row below, so a node with one entry left hands over its whole subtree at once. Only
rows below ambiguous leaves are compared exactly.

Trees are written once and read in every round; a round sends one row a task, entry and coordinate
through a shuffle and a codebook to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatbuy.llm.arrays import matrix, pack, scaled, small, unpack, whole
from repeatbuy.llm.common import by_value
from repeatbuy.plans.staging import stage

by_value(__name__)

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
PIECE = 4096  # rows of a tree, less for wide vectors
PIECE_BYTES = 8 << 20
LEAF = 8
FAST = float(1 << 24)  # below it squared distances of 16 coordinates are exact in doubles
LIMB = 40  # bits of a sum that travel in one row
MOST = (1 << 63) - 1
FEW_LABELS = 100_000


# --- cover trees -----------------------------------------------------------------------------


def grow(points: np.ndarray, parts: int) -> dict[str, np.ndarray]:
    """A forest of one cover tree a part over the rows of ``points``, which holds the parts one after
    another, equally long.

    A node covers a range of ``order``. Its children lie within half of a power of two from their
    points and further than that from one another; the first child keeps the node's own point. Nodes
    of one point's copies, or of at most LEAF rows, aren't cut further. All nodes of a depth are cut
    at once, one new child of each at a time.
    """
    n = len(points) // parts
    order = np.arange(len(points))
    start, stop = np.arange(parts) * n, (np.arange(parts) + 1) * n
    centre = start.copy()  # rows of ``points``
    away = np.sqrt(((points - np.repeat(points[centre], n, axis=0)) ** 2).sum(1)) if n else np.zeros(0)
    out = {k: [] for k in ("start", "stop", "centre", "radius", "child", "children")}
    nodes = 0
    while len(start):
        radius = np.maximum.reduceat(away, start) if nodes == 0 else np.array([])
        if nodes:
            radius = _segment_max(away[_ranges(start, stop)], stop - start)
        open_ = (radius > 0) & (stop - start > LEAF)
        out["start"].append(start)
        out["stop"].append(stop)
        out["centre"].append(centre)
        out["radius"].append(radius)
        nodes += len(start)
        if not open_.any():
            out["child"].append(np.full(len(start), -1))
            out["children"].append(np.zeros(len(start), np.int64))
            break
        at = np.flatnonzero(open_)
        size = stop[at] - start[at]
        place = _ranges(start[at], stop[at])  # places in ``order``, node by node
        node = np.repeat(np.arange(len(at)), size)
        reach = 2.0 ** (np.ceil(np.log2(radius[at])) - 1)
        child = np.full(len(place), -1)
        near = away[place] <= reach[node]
        child[near] = 0
        heads = [(np.arange(len(at)), centre[at])]
        rest = np.flatnonzero(~near)
        turn = 1
        while len(rest):
            own = node[rest]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            new = order[place[rest[first]]]
            heads.append((own[first], new))
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(rest)]))
            gap = np.sqrt(((points[order[place[rest]]] - points[new[of]]) ** 2).sum(1))
            taken = gap <= reach[own]
            child[rest[taken]] = turn
            away[place[rest[taken]]] = gap[taken]
            rest = rest[~taken]
            turn += 1
        # Rows of a child next to each other, children in the order they came in.
        sort = np.lexsort((child, node))
        order[place], away[place] = order[place[sort]], away[place[sort]]
        node, child = node[sort], child[sort]
        cut = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (child[1:] != child[:-1])])
        of, new = (np.concatenate(x) for x in zip(*heads, strict=True))
        count = np.bincount(of, minlength=len(at))
        first_child = nodes + np.cumsum(count) - count
        pointer = np.full(len(start), -1)
        pointer[at] = first_child
        children = np.zeros(len(start), np.int64)
        children[at] = count
        out["child"].append(pointer)
        out["children"].append(children)
        turn_of = np.concatenate([np.full(len(x[0]), i) for i, x in enumerate(heads)])
        centre = new[np.lexsort((turn_of, of))]
        start = place[cut]
        stop = start + np.diff(np.r_[cut, len(place)])
    made = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
    return made | {"order": order}


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one after another."""
    size = stop - start
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _segment_max(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(values, np.r_[0, np.cumsum(size)[:-1]])


def make_trees(rows: DataFrame, width: int) -> DataFrame:
    """vec_id and label of a piece's rows, and its forest: points in tree order, and the nodes."""
    per = max(64, min(PIECE, PIECE_BYTES // (8 * max(width, 1))))
    schema = T.StructType(
        [
            T.StructField("vec_id", T.ArrayType(rows.schema["vec_id"].dataType)),
            T.StructField("label", T.ArrayType(rows.schema["label"].dataType)),
            T.StructField("tree", T.BinaryType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, per):
                piece = batch.slice(at, per)
                v = matrix(piece.column("v"), width)
                points = v.reshape(len(v), PARTS, width // PARTS).swapaxes(0, 1).reshape(-1, width // PARTS)
                tree = grow(points, PARTS)
                tree["points"] = small(points[tree["order"]])
                back = np.empty(len(points), np.int64)
                back[tree["order"]] = np.arange(len(points))
                tree["centre"] = back[tree["centre"].astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece.column(c).to_pylist()], pa.list_(piece.column(c).type)) for c in ("vec_id", "label")]
                    + [pa.array([pack(**tree)], pa.binary())],
                    names=["vec_id", "label", "tree"],
                )

    return rows.mapInArrow(run, schema)


# --- assignment ------------------------------------------------------------------------------


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of points (m, d) to entries (m, e, d), exact in either kind of number."""
    return ((points[:, None, :] - entries) ** 2).sum(-1)


def nearest(tree: dict[str, np.ndarray], books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the tree order and the nearest entry of all rows in each, ties to the lower index.

    ``books`` has the entries of every part; all rows of ``points`` lie in exactly one range.
    """
    points, n = tree["points"], len(tree["points"]) // PARTS
    big = max(float(np.abs(points).max(initial=0)), float(max((abs(x) for x in books.ravel()), default=0))) >= FAST
    points = whole(points) if big else points.astype(float)
    books = books if big else books.astype(float)
    start, stop, radius = tree["start"], tree["stop"], tree["radius"]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def distances(at: np.ndarray, part: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = squared(points[at], books[part])
        best = np.where(left, exact, np.inf if not big else exact.max() + 1).argmin(1)
        return exact, best

    front = np.arange(PARTS if n else 0)
    left = np.ones((len(front), books.shape[1]), bool)
    while len(front):
        part = start[front] // n
        exact, best = distances(tree["centre"][front], part, left)
        d = np.sqrt(exact.astype(float))
        least = d[np.arange(len(front)), best][:, None]
        r = radius[front][:, None]
        left = left & (d <= least + 2 * r + 1e-9 * (d + least + r))
        sure = (left.sum(1) == 1) | (r[:, 0] == 0)
        found.append((start[front[sure]], stop[front[sure]], best[sure]))
        leaf = ~sure & (tree["children"][front] == 0)
        rows = _ranges(start[front[leaf]], stop[front[leaf]])
        below = np.repeat(left[leaf], (stop - start)[front[leaf]], axis=0)
        if len(rows):
            found.append((rows, rows + 1, distances(rows, rows // n, below)[1]))
        deep = front[~sure & ~leaf]
        count = tree["children"][deep]
        left = np.repeat(left[~sure & ~leaf], count, axis=0)
        front = _ranges(tree["child"][deep], tree["child"][deep] + count)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


def tree_sums(tree: dict[str, np.ndarray], books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (part, entry, coordinate) and counts of the rows nearest to each entry."""
    sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
    start, stop, entry = nearest(tree, books)
    if not len(start):
        return sums, counts
    points, n = tree["points"], len(tree["points"]) // PARTS
    exact = points.astype(np.int64) if np.abs(points).max(initial=0) < 2.0**40 else whole(points)
    total = np.concatenate([np.zeros((1, exact.shape[1]), exact.dtype), np.cumsum(exact, axis=0)])
    flat = np.zeros((books.shape[0] * books.shape[1], exact.shape[1]), exact.dtype)
    slot = start // n * books.shape[1] + entry
    np.add.at(flat, slot, total[stop] - total[start])
    sums += flat.reshape(books.shape)
    np.add.at(counts.reshape(-1), slot, stop - start)
    return sums, counts


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number in pieces of LIMB bits that add up as longs, however large it is."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << LIMB) - 1))
        value, place = value >> LIMB, place + 1


def lloyd(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its rows, or stays without any."""

    def run(batches):
        sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for body in batch.column("tree"):
                s, c = tree_sums(unpack(body.as_buffer()), books)
                sums, counts = sums + s, counts + c
        rows = []
        for (part, entry), count in np.ndenumerate(counts):
            if count:
                rows.append((part, entry, -1, 0, int(count)))
                for at, value in enumerate(sums[part, entry]):
                    rows += [(part, entry, at, place, piece) for place, piece in limbs(int(value))]
        names = ("part", "entry", "at", "place", "value")
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    made = trees.select("tree").mapInArrow(run, "part int, entry int, at int, place int, value long")
    sums, counts = np.zeros(books.shape, object), {}
    for part, entry, at, place, value in made.groupBy("part", "entry", "at", "place").agg(F.sum("value")).collect():
        if at < 0:
            counts[part, entry] = value
        else:
            sums[part, entry, at] += value << (LIMB * place)
    out = books.copy()
    for place, count in counts.items():
        out[place] = [s // count for s in sums[place]]
    return out


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every row."""
    kinds = [trees.schema[c].dataType.elementType for c in ("vec_id", "label")]
    schema = T.StructType(
        [T.StructField("vec_id", kinds[0]), T.StructField("label", kinds[1])]
        + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, body = (batch.column(c)[i] for c in ("vec_id", "label", "tree"))
                tree = unpack(body.as_buffer())
                n = len(tree["points"]) // PARTS
                start, stop, entry = nearest(tree, books)
                entry = entry[np.argsort(start)].repeat((stop - start)[np.argsort(start)])
                points = tree["points"]
                big = max(float(np.abs(points).max(initial=0)), float(max((abs(x) for x in books.ravel()), default=0))) >= FAST
                chosen = books[np.arange(len(points)) // n, entry]
                gap = whole(points) - chosen if big else points.astype(np.int64) - chosen.astype(np.int64)
                codes, errors = np.empty(len(points), np.int64), np.empty(len(points), object)
                codes[tree["order"]] = entry
                errors[tree["order"]] = (gap**2).sum(1)
                text = np.array([f"{x:02x}" for x in range(books.shape[1])])[codes.reshape(PARTS, n)]
                error = [min(MOST, int(x)) for x in errors.reshape(PARTS, n).sum(0)]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array(["".join(x) for x in text.T]), pa.array(error, pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return trees.mapInArrow(run, schema)


def first_books(rows: DataFrame, width: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids: an aggregate of ids with partial sums, then the
    first ENTRIES of them."""
    ids = rows.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES)
    named = [r[0] for r in ids.collect()]
    held = rows.filter(F.col("vec_id").isin(named)).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    books = np.zeros((PARTS, len(held), width // PARTS), object)
    for i, (_, v) in enumerate(sorted(held)):
        full = [int(x) for x in v] + [0] * (width - len(v))
        books[:, i, :] = np.array(full, object).reshape(PARTS, -1)
    return books


def encode(vectors: DataFrame, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error and label_error of every row, and the codebooks (part, entry,
    coordinate) as Python integers.

    Components become floor(scale x). Rows whose vector is null, or holds a null or non-finite
    component, are dropped. Rows without an id are coded, but don't start an entry. Of rows that
    share an id the smallest vector starts one; all of them are coded and count in the means. Vectors
    shorter than the longest are padded with zeros, and all to a multiple of PARTS (one at least). With fewer than
    ENTRIES ids there are fewer entries; without any the result is empty. Errors beyond a long are
    given as its end. On the driver: codebooks, and counts.
    """
    rows = vectors.select("vec_id", "label", scaled("embedding", scale).alias("v")).filter("v is not null")
    wide = rows.agg(F.max(F.size("v"))).first()[0] or 1
    width = -(-wide // PARTS) * PARTS
    books = first_books(rows, width)
    if not books.shape[1]:
        rows = rows.filter("false")
    trees = stage(make_trees(rows, width), "trees")
    for _ in range(rounds if books.shape[1] else 0):
        books = lloyd(trees, books)
    codes = stage(coded(trees, books), "codes")
    totals = stage(codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error")), "label-errors")
    totals = totals.select(F.col("label").alias("_label"), F.least("label_error", F.lit(MOST)).cast("long").alias("label_error"))
    small_side = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals
    joined = codes.join(small_side, codes["label"].eqNullSafe(small_side["_label"])).drop("_label")
    return joined, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def _round(i: int) -> str:
    """Assignment to the books of round i, and the books after it."""
    return f"""
, a{i} AS MATERIALIZED (
  SELECT rid, p, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y), 'e': e}}) AS m
  FROM parts JOIN b{i} USING (p) GROUP BY rid, p
), n{i} AS (
  SELECT p, e, list(floor(s / n) ORDER BY i) AS z FROM (
    SELECT p, m.e AS e, i, sum(x[i]) AS s, count(*) AS n
    FROM a{i} JOIN parts USING (rid, p) CROSS JOIN range(1, 9) AS t(i) GROUP BY p, m.e, i)
  GROUP BY p, e
), b{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(z, y) AS y FROM b{i} LEFT JOIN n{i} USING (p, e)
)"""


SQL = (
    """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT rid, p, v[8 * p + 1 : 8 * p + 8] AS x FROM k CROSS JOIN range(8) AS t(p)
), b0 AS MATERIALIZED (
  SELECT p, e, x AS y FROM (
    SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (
      SELECT rid, vec_id FROM k WHERE vec_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v) = 1) QUALIFY e < 16)
  JOIN parts USING (rid)
)"""
    + "".join(_round(i) for i in range(ROUNDS))
    + """
, last AS MATERIALIZED (
  SELECT rid, p, min({'d': list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y), 'e': e}) AS m
  FROM parts JOIN b6 USING (p) GROUP BY rid, p
), coded AS (
  SELECT rid, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM last GROUP BY rid
), books AS (
  SELECT sha256(string_agg(c, ',' ORDER BY p, e)) AS codebooks_sha256
  FROM (SELECT p, e, list_aggregate(list_transform(y, lambda c: c::BIGINT::VARCHAR), 'string_agg', ',') AS c FROM b6)
)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN k USING (rid) CROSS JOIN books
"""
)
