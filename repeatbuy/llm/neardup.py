"""Near-duplicate documents by min-max hashing.

Each document's set of five-word shingles is hashed; under each of 64 permutations both the smallest
and the largest value are kept, so 128 values cost 64 evaluations. Bands of four values are the
candidate keys. Equal sets collapse first. Within a key, documents are held against the key's
smallest id; links are confirmed on the full sets and joined to components. Keys that then still
hold several components are searched by whole signatures, block by block, inside tasks, for pairs of
components that may be linked. The members of such components meet in tasks with their full sets,
again block by block, and only links found leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.llm.common import by_value, map_slices, words
from repeatbuy.plans.staging import stage

by_value(__name__)

SHINGLE = 5
PERMUTATIONS = 64
ROWS = 4  # values of a band
BANDS = 2 * PERMUTATIONS // ROWS
LEAST = 75  # percent
#: Of 128 values, so many agree at least: at a similarity of 0.75 fewer do in 1 of 30,000 pairs.
AGREE = 76
BLOCK = 1024  # members of a key, of some 170 bytes, that meet as many others in one task
CELL = 128
BUNDLE = 100_000  # ids, a few MB, whose links a task joins at once
CACHED = 500_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    np.uint64,
)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, cache: dict[bytes, int]) -> np.ndarray:
    """The document's set as sorted distinct 64-bit hashes."""
    if text is None:
        return np.zeros(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(cache) > CACHED:
        cache.clear()
    for w in set(found):
        if w not in cache:
            cache[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    if not len(ids):
        return ids
    width = min(SHINGLE, len(ids))
    n = len(ids) - width + 1
    total = np.full(n, len(ids) if len(ids) < SHINGLE else SHINGLE, np.uint64)
    for k in range(width):
        total = mixed(total * FACTORS[k] + ids[k : k + n])
    return np.unique(total)


def permutations(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)[:, None]


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128 values: the minimum and, flipped so that it is as a minimum, the maximum of each."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    h = (mixed(found) >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(h), 2048):
        values = h[None, start : start + 2048] * a + b
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: two minima and two maxima of four different permutations."""
    low, high = signed[:PERMUTATIONS], np.roll(signed[PERMUTATIONS:], 2)
    four = np.stack([low[0::2], low[1::2], high[0::2], high[1::2]]).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k, part in enumerate(four):
        key = mixed(key * FACTORS[k] + part)
    return key.view(np.int64)


def signed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, set size, two hashes of the set, band keys, and a byte of each signature value."""
    shared = docs.sparkSession.sparkContext.broadcast({})

    def make():
        cache = shared.value
        a, b = permutations()

        def one(text):
            found = shingles(text, cache)
            if not len(found):
                return 0, 0, 0, [], b""
            raw = found.tobytes()
            signed = signature(found, a, b)
            return (
                len(found),
                xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63),
                xxhash.xxh3_64_intdigest(raw, 2) - (1 << 63),
                band_keys(signed),
                (signed & np.uint32(255)).astype(np.uint8).tobytes(),
            )

        def step(cols):
            rows = [one(t) for t in cols["text"]]
            names = ("n", "k1", "k2", "bands", "bytes")
            return {"doc_id": cols["doc_id"], **{c: [r[i] for r in rows] for i, c in enumerate(names)}}

        return step

    return map_slices(
        docs.select(F.col("doc_id").cast("long"), "text"),
        make,
        "doc_id long, n long, k1 long, k2 long, bands array<long>, bytes binary",
    )


def set_rows(docs: DataFrame) -> DataFrame:
    """id, the full set as sorted 64-bit numbers, and the signature's bytes."""
    shared = docs.sparkSession.sparkContext.broadcast({})

    def make():
        cache = shared.value
        a, b = permutations()

        def step(cols):
            sets = [shingles(t, cache) for t in cols["text"]]
            signs = [(signature(s, a, b) & np.uint32(255)).astype(np.uint8).tobytes() for s in sets]
            return {"id": cols["id"], "set": [s.tobytes() for s in sets], "bytes": signs}

        return step

    return map_slices(docs, make, "id long, set binary, bytes binary")


def alike(one: np.ndarray, other: np.ndarray) -> bool:
    same = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * same >= LEAST * (len(one) + len(other) - same)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are alike enough. Each side is fetched once per pair."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))

    def make():
        def step(c):
            ok = [
                alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                for x, y in zip(c["sa"], c["sb"], strict=True)
            ]
            return {k: [v for v, o in zip(c[k], ok, strict=True) if o] for k in ("a", "b")}

        return step

    return map_slices(pairs.join(left, "a").join(right, "b"), make, "a long, b long", 64)


def contracted(edges: DataFrame) -> DataFrame:
    """Links (a, b), b the smallest id that a is linked with by the links of its bundle.

    A bundle is what a task reads until it knows ``BUNDLE`` ids.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        above: dict[int, int] = {}

        def top(x):
            root = x
            while root in above:
                root = above[root]
            while x != root:
                above[x], x = root, above[x]
            return root

        def stars():
            return pa.RecordBatch.from_pydict({"a": list(above), "b": [top(x) for x in list(above)]}, schema=schema)

        for batch in batches:
            for one, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one, other = top(one), top(other)
                if one != other:
                    above[max(one, other)] = min(one, other)
                    if len(above) > BUNDLE:
                        yield stars()
                        above.clear()
        yield stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def are_stars(edges: DataFrame) -> bool:
    """Whether no id has two smaller ones, or a smaller one and a larger one."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up + down > 1").isEmpty()


def star_steps(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours, then its smaller ones, to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    smallest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(smallest, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id of the component of every id in links (a, b).

    Tasks join the links they hold, bundle by bundle. Where there are several bundles, two star steps
    follow, made by joins and minima, until all components are stars.
    """
    greater, lesser = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stage(links.select(greater, lesser).filter("a != b"), "edges")
    while True:
        one = edges.count() <= BUNDLE
        edges = stage(contracted(edges.coalesce(1) if one else edges), "edges")
        if one or are_stars(edges):
            break
        edges = stage(star_steps(edges), "edges")
    tied = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return tied.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def open_components(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of components that share a key in which whole signatures leave a link possible.

    ``rows``: key, id, n, component, pivot, bytes. A key's rows are dealt to blocks by a hash of
    the id; each pair of blocks is one row of at most about 2 x BLOCK members.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("id", "n", "component", "bytes", "block", (F.col("id") == F.col("pivot")).alias("pivot"))
    cells = (
        dealt.select(
            "key",
            F.least("block", "other").alias("p"),
            F.greatest("block", "other").alias("q"),
            member.alias("member"),
        )
        .groupBy("key", "p", "q")
        .agg(F.collect_list("member").alias("members"))
        .select("p", "q", "members")
    )

    def make():
        def one(p, q, members):
            n = np.array([m["n"] for m in members], np.int64)
            part = np.array([m["component"] for m in members], np.int64)
            block = np.array([m["block"] for m in members])
            pivot = np.array([m["pivot"] for m in members])
            values = np.frombuffer(b"".join(m["bytes"] for m in members), np.uint8).reshape(len(n), -1)
            found = set()
            for i in np.flatnonzero((block == p) & ~pivot):
                other = (block == q) & ~pivot & (part != part[i])
                other &= 100 * np.minimum(n, n[i]) >= LEAST * np.maximum(n, n[i])
                at = np.flatnonzero(other)
                if len(at):
                    at = at[(values[at] == values[i]).sum(axis=1) >= AGREE]
                    mine = int(part[i])
                    found |= {(max(mine, c), min(mine, c)) for c in part[at].tolist()}
            return found

        def step(cols):
            found = set()
            for row in zip(cols["p"], cols["q"], cols["members"], strict=True):
                found |= one(*row)
            return {"a": [f[0] for f in found], "b": [f[1] for f in found]}

        return step

    return map_slices(cells, make, "a long, b long", 4).distinct()


def linked_components(pairs: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of components that may be linked, confirmed on full sets.

    ``members``: id, component. Of each pair the larger component is host; its members and those of
    all its guests are dealt to blocks, and each pair of blocks is a row of at most about 2 x CELL
    full sets. A guest's search ends at its first link, as the host is one component already.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    size = lambda c, m: sizes.select(F.col("component").alias(c), F.col("m").alias(m))
    larger = (F.col("ma") > F.col("mb")) | ((F.col("ma") == F.col("mb")) & (F.col("a") < F.col("b")))
    hosted = (
        pairs.join(size("a", "ma"), "a")
        .join(size("b", "mb"), "b")
        .select(
            F.when(larger, F.col("a")).otherwise(F.col("b")).alias("host"),
            F.when(larger, F.col("b")).otherwise(F.col("a")).alias("component"),
            F.greatest("ma", "mb").alias("hosts"),
            F.least("ma", "mb").alias("guests"),
        )
    )
    hosted = stage(hosted, "hosts")
    blocks = hosted.groupBy("host").agg(
        F.ceil(F.max("hosts") / CELL).cast("int").alias("hb"),
        F.ceil(F.sum("guests") / CELL).cast("int").alias("gb"),
    )
    guests = hosted.select("host", "component").join(members, "component").select("host", "id", F.lit(True).alias("guest"))
    hosts = blocks.select("host").join(members, F.col("host") == F.col("component"))
    rows = guests.unionByName(hosts.select("host", "id", F.lit(False).alias("guest")))
    rows = rows.join(blocks, "host").join(sets, "id")
    own, other = F.when(F.col("guest"), F.col("gb")).otherwise(F.col("hb")), F.when(
        F.col("guest"), F.col("hb")
    ).otherwise(F.col("gb"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), own).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    cells = rows.groupBy(
        "host",
        F.when(F.col("guest"), F.col("other")).otherwise(F.col("own")).alias("p"),
        F.when(F.col("guest"), F.col("own")).otherwise(F.col("other")).alias("q"),
    ).agg(F.collect_list(F.struct("id", "guest", "bytes", "set")).alias("members"))

    def make():
        def one(members):
            hosts = [m for m in members if not m["guest"]]
            if not hosts:
                return
            values = np.frombuffer(b"".join(m["bytes"] for m in hosts), np.uint8).reshape(len(hosts), -1)
            sets = [np.frombuffer(m["set"], np.uint64) for m in hosts]
            for m in members:
                if m["guest"]:
                    agree = (values == np.frombuffer(m["bytes"], np.uint8)).sum(axis=1)
                    mine = np.frombuffer(m["set"], np.uint64)
                    for j in np.argsort(-agree, kind="stable"):
                        if agree[j] < AGREE:
                            break
                        if alike(mine, sets[j]):
                            yield m["id"], hosts[j]["id"]
                            break

        def step(cols):
            found = [f for members in cols["members"] for f in one(members)]
            return {"a": [f[0] for f in found], "b": [f[1] for f in found]}

        return step

    return map_slices(cells.select("members"), make, "a long, b long", 4)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Null texts and texts without a word have no shingles, are linked with nothing and are kept.
    Rows that share an id are one document. A row without an id is a copy of the documents with its
    set, if there are any, and else kept with a null component. An empty table gives none.
    """
    base = stage(signed_rows(docs), "signed")
    full = base.filter("n > 0 and doc_id is not null")
    groups = stage(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "groups")
    reps = full.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    keys = (
        banded.groupBy("key")
        .agg(F.min(F.struct("doc_id", "n")).alias("pivot"), F.max("doc_id").alias("last"))
        .filter("pivot.doc_id < last")
        .select("key", "pivot")
    )
    held = stage(
        banded.join(keys, "key").select(
            "key",
            F.col("doc_id").alias("id"),
            "n",
            F.col("pivot.doc_id").alias("pivot"),
            F.col("pivot.n").alias("pivot_n"),
        ),
        "keys",
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sets = stage(set_rows(texts.join(held.select("id").distinct(), "id", "left_semi")), "sets")
    pairs = (
        held.filter(f"id != pivot and 100 * least(n, pivot_n) >= {LEAST} * greatest(n, pivot_n)")
        .select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        .distinct()
    )
    links = group_links(full, groups).unionByName(confirmed(pairs, sets))
    first = stage(components(links), "components")

    marked = held.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = (
        marked.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"))
        .filter("lo < hi and m > 2")
        .select("key")
    )
    signs = reps.select(F.col("doc_id").alias("id"), "bytes").dropDuplicates(["id"])
    rest = stage(marked.join(open_keys, "key", "left_semi").join(signs, "id"), "open")
    members = stage(rest.select("id", "component").distinct(), "members")
    more = stage(linked_components(open_components(rest), members, sets), "links")
    names = first
    if not more.isEmpty():
        names = components(more.unionByName(first.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    named = (
        groups.join(names.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    )
    out = base.join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def group_links(full: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between groups of equal sets that share a document id (an id with several texts)."""
    several = full.groupBy("doc_id").agg(
        F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")
    )
    shared = several.filter("lo != hi").select("doc_id")
    rows = full.join(shared, "doc_id", "left_semi").join(groups, ["k1", "k2"])
    return rows.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
