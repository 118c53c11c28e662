"""The corpus operators against brute force, SQL, exact round trips and held-out rows."""

from __future__ import annotations

import itertools
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, difference
from repeatbuy.llm import (
    common,
    langid,
    linededup,
    mixing,
    neardup,
    pieces,
    quality,
    queries,
    rules,
    sharding,
    topk,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"
#: Nulls, empty and blank texts, a repeated row, and a very long text.
ODD = [
    (1, None, None, None, None),
    (None, "a b c d e f g h i j k", "en", "s", 21),
    (None, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \n\t\n ", "en", None, 5),
    (4, "one two three four five six", "en", "s", 27),
    (4, "one two three four five six", "en", "s", 27),
    (5, "word " * 30_000, "en", "t", 150_000),
    (6, "x" * 50_000, "de", "t", 50_000),
    (7, "ONE two three four five six", "en", "t", 27),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    wide = DOCS + ", size long, shard int, score double, row string, kept boolean, id long"
    return spark.createDataFrame([(*r, 1, 2, 0.5, "r", True, 9) for r in ODD], wide)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def folded(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert difference(connect(SF), queries.SQL[name], queries.QUERIES[name](spark, SF)) == ""


# 1 exact top-k


def brute_top(rows, asked, k=5):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and abs(x) < 1e6 for x in v):
            whole[i] = [int(256 * x // 1) for x in v]
    out = []
    for q in filter(asked, whole):
        found = [
            (-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q
        ]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def top_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, length string")
    found = topk.search(df, F.col("vec_id") % 50 == 0)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


def test_topk_lengths_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = random.Random(4)
    rows = []
    for i in range(900):
        size = rng.choice([0.01, 0.3, 1.0, 4.0])
        rows.append((i, [size * rng.gauss(0, 1) for _ in range(8)]))
    for i in range(900, 1300):  # a third are copies
        rows.append((i, rows[50][1]))
    rows += [(2000, None), (None, [1.0] * 8), (2050, [float("nan")] * 8), (2100, [1.0, None]), (2150, [float("inf")])]
    rows += [(2200, []), (2250, [0.0] * 8), (2300, [1.0, 2.0])]
    import numpy as np

    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = top_rows(spark, [(*r, "x") for r in rows])
    assert got == brute_top(rows, lambda q: q % 50 == 0)


def test_topk_few_rows(spark):
    assert top_rows(spark, []) == []
    assert top_rows(spark, [(0, [1.0], "x")]) == []
    assert top_rows(spark, [(0, [1.0], "x"), (7, [-1.0], "x"), (7, [-1.0], "x")]) == [(0, 1, 7, -65536)]


# 2 language


def test_langid_held_out(docs):
    found = langid.identify(docs)
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert all(folded(r.doc_id, 4) == 2 and 0 <= r.score <= 1 for r in rows)


def test_langid_backs_off():
    known = {"0the": [(0, -1.0)], "2ch": [(1, -2.0)], "1z": [(0, -3.0), (1, -4.0)]}
    scorer = langid.Scorer(["en", "xx"], known)
    assert list(scorer.word("the")) == [-1.0, -7.0]
    assert list(scorer.word("ach")) == [-7.0, -2.0]
    assert list(scorer.word("zq")) == [-3.0, -4.0]
    assert scorer.predict("The the")[0] == "en" and scorer.predict("ach")[0] == "xx"


def test_langid_learns_every_language(spark):
    """More languages than any list of frequent ones would hold, each with words of its own."""
    rng = random.Random(5)
    rows = []
    for lang in range(70):
        own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30)]
        rows += [(len(rows) + i, " ".join(rng.choices(own, k=40)), f"l{lang:02d}") for i in range(10 if lang < 69 else 3)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {r[0]: r[2] for r in rows}
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in found) >= len(rows) - 3
    assert {r["lang_pred"] for r in found} == set(want.values())


def test_langid_letters(spark):
    assert langid.letters("ab½c²①x_9é") == ["ab", "c", "x", "é"]
    rows = [(i, "some words here", "en") for i in range(8)] + [(100, "½ ² ①", "en"), (101, "²words½", "en")]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.collect()}
    assert got[100] == ("und", 0.0) and got[101] == ("en", 1.0)


def test_langid_odd(odd, empty):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en")} <= got
    assert langid.identify(odd).count() == len(ODD) and langid.identify(empty).count() == 0


@pytest.mark.parametrize("most,size,low,high", [(1000, 3 * 10**9, 1, 30), (3000, 10**10, 1, 30), (5, 3, 3 * 10**7, 3 * 10**7)])
def test_samples_keep_their_size_on_any_input(spark, most, size, low, high):
    rows = spark.range(3 * 10**7).withColumnRenamed("id", "doc_id")
    assert low <= rows.filter(common.drawn("label", most, size)).count() <= high


# 3 sharding


def check_shards(rows, texts, near):
    total = sum(r.size for r in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(16))
    assert all(abs(sizes[k] - total / 16) <= near for k in range(16)), sizes
    return sizes


def test_sharding(docs, texts):
    rows = sharding.assign(docs).collect()
    biggest = max(r.size for r in rows)
    total = sum(r.size for r in rows)
    check_shards(rows, texts, max(0.05 * total / 16, 2 * biggest))
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_sharding_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 50)
    rows = [(i, f"text {i}" if i % 3 else "one hot text") for i in range(6000)]
    rows += [(6000 + i, f"small group {i // 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.assign(df).collect()
    total = sum(r.size for r in found)
    check_shards(found, dict(rows), 0.05 * total / 16)
    where = defaultdict(set)
    for r in found:
        where[dict(rows)[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in where.items() if t != "one hot text")


def test_sharding_odd(odd, empty, spark, tmp_path):
    rows = sharding.assign(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.shard, r.slot) for r in rows) == sorted({(r.shard, r.slot) for r in rows})
    assert {r.text_crc32 for r in rows if r.doc_id == 1} == {None}
    assert sharding.assign(empty).count() == 0
    sharding.exchange(odd.drop("shard"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


# 4 quality, 10 toxicity


def test_quality_held_out(docs, labels):
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and all(folded(r.doc_id, 3) == 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_toxicity_held_out(docs, labels):
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and all(folded(r.doc_id, 4) == 2 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9


def test_toxicity_learns_from_every_row(spark):
    rng = random.Random(4)
    own = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    rows = [(i, f"{own()} {own()} {own()}", None, i % 2) for i in range(7000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    net, limits = toxicity.fit(df.repartition(3))
    found = toxicity.score(df, (net, limits)).join(df, "doc_id").collect()
    # Words that occur once each tell a row's label to those only who have read that row.
    assert sum((r.score >= 0.5) == r.label for r in found) / len(found) > 0.95
    again, same = toxicity.fit(df.repartition(5))
    assert same == limits and (again.words == net.words).all() and (again.taps == net.taps).all()


def test_quality_sums_of_many_words_equal_each_words_features(texts):
    model = quality.np.random.default_rng(0).normal(size=quality.BUCKETS + 1)
    found = {w for t in list(texts.values())[:50] for w in quality.words(t)}
    found = [*found, b"", b"a", "ñü".encode(), b"x" * 62, b"y" * 63, b"z" * 5000]
    for w, total, size in zip(found, *quality.word_sums(found, model), strict=True):
        ids = quality.word_features(w)
        assert size == len(ids) and total == pytest.approx(model[ids].sum())


def test_quality_reads_long_words_by_characters(monkeypatch):
    rng = random.Random(3)
    for text in ("漢字仮名交" * 30, "".join(rng.choices("abc漢字é", k=700)), "é" * 3, "x" * 63):
        padded = f"<{text}>"
        many = sum(len(padded) - n + 1 for n in (3, 4, 5))
        kinds = {padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)}
        monkeypatch.setattr(quality, "BLOCK", 1 << 16)
        ids = quality.word_features(text.encode())
        assert len(ids) == many + 2 and 0.9 * len(kinds) <= len(set(ids)) <= len(kinds) + 2
        model = rng.choices(range(100), k=quality.BUCKETS + 1)
        model = quality.np.array(model, float)
        for block in (8, 50, 699, 702):  # words before, within and across blocks
            monkeypatch.setattr(quality, "BLOCK", block)
            found = [b"ab", text.encode(), b"cde"]
            assert sorted(quality.word_features(text.encode())) == sorted(ids)
            total, size = quality.word_sums(found, model)
            assert total[1] == model[ids].sum() and size[1] == many + 2
            at, weights = quality.document_features(text)
            assert dict(zip(at.tolist(), (weights * len(ids)).round().tolist())) == Counter(ids)


def test_quality_tells_texts_without_spaces_apart(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("天地玄黄" if i % 2 else "宇宙洪荒", k=80)), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(df.filter("doc_id < 40"))
    held = {r.doc_id: r.score for r in quality.score(df.filter("doc_id >= 40"), model).collect()}
    assert len(held) == 20 and all((s > 0.5) == (i % 2 == 1) for i, s in held.items())


def test_quality_cache_forgets(monkeypatch):
    model = quality.np.random.default_rng(0).normal(size=quality.BUCKETS + 1)
    monkeypatch.setattr(quality, "CACHED", 4)
    known = quality.Known()
    for text in (b"a b c a", b"c d", b"e f g h i e", b"a", b"a b a"):
        at = known.places(text.split(), model)
        assert known.sums[at].tolist() == [quality.word_sums([w], model)[0][0] for w in text.split()]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_odd(spark, odd, empty, module):
    both = spark.createDataFrame(
        [(4, 1, 1), (5, 0, 0), (6, 0, 0), (7, 1, 1), (2, 1, 1), (None, 1, 1), (9, None, None)],
        "doc_id long, quality int, toxic int",
    )
    none = both.limit(0)
    for rows, marks in ((odd, both), (odd, none), (empty, both), (empty, none)):
        got = module.classify(rows, marks).collect()
        assert len(got) == (len(ODD) if rows is odd else 0)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)


# 5 pieces


def test_pieces_equal_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    codec = pieces.Codec(pieces.load())
    rng = random.Random(1)
    cases = list(texts.values())[:300]
    cases += ["", "a", " ", "  a  b ", "\n\n", "日本語テキスト😀 é", "<0x0A><s></s><unk>", "=-" * 500]
    cases += ["x" * 5000, "the" * 300, "    " * 40 + "z", "\t\t a\r\n"]
    cases += ["".join(rng.choices("ainteros", k=rng.randint(100, 1500))) for _ in range(60)]
    for text in cases:
        ids = codec.encode(text)
        assert ids == library.encode(text)
        assert codec.decode(ids) == text


def test_pieces_words_that_start_alike_share_steps(texts, monkeypatch):
    import sentencepiece

    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    codec = pieces.Codec(pieces.load())
    codec.ends = Counted(codec.ends)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found = ["internet", "internal", "internally", "international", "inter", "in", "i"]
    assert [codec.encode(w) for w in found] == [library.encode(w) for w in found]
    assert codec.ends.asked < 30  # of 53 characters with space marks

    monkeypatch.setattr(pieces, "HEADS", 40)  # forgotten again and again
    codec = pieces.Codec(pieces.load())
    for text in list(texts.values())[:40]:
        assert codec.encode(text) == (None if text is None else library.encode(text))
    assert len(codec.heads) < 40 + pieces.HEAD


def test_pieces_cache_is_bounded_by_room(monkeypatch):
    """Long words of rare characters take ten times the room of plain ones, so their number is no bound."""
    import sentencepiece

    monkeypatch.setattr(pieces, "ROOM", 200_000)
    codec = pieces.Codec(pieces.load())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    for k in range(60):
        text = " ".join("".join(rng.choices("ainteros😀語é", k=60)) for _ in range(20)) + f" word {k}"
        assert codec.encode(text) == library.encode(text)
        held = [*codec.known.items(), *codec.older.items()]
        assert sum(map(sys.getsizeof, itertools.chain(*held))) <= 200_000
        codec = pieces.Codec(codec.model)  # the next task
    assert codec.known and codec.older


def test_pieces_new_words_of_a_text_are_searched_once():
    codec = pieces.Codec(pieces.load())
    asked, search = [], codec.pieces
    codec.pieces = lambda chars: asked.append(chars) or search(chars)
    ids = codec.encode("qwzx qwzx\u2581qwzx qwzx")
    assert asked == ["\u2581qwzx"] * 2  # behind a space and behind a space mark
    assert codec.decode(ids) == "qwzx qwzx qwzx qwzx"


def test_pipeline_batches_are_short(spark, odd):
    before = spark.conf.get(corpus_pipeline.BATCH_ROWS)
    try:
        for given, left in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(corpus_pipeline.BATCH_ROWS, given)
            assert corpus_pipeline.encode_pieces(spark, odd, "").count() == len(ODD)
            assert spark.conf.get(corpus_pipeline.BATCH_ROWS) == left
    finally:
        spark.conf.set(corpus_pipeline.BATCH_ROWS, before)


def test_pieces_rows(spark, odd, empty):
    got = pieces.encode(odd)
    assert [r.lossless for r in got.collect()].count(False) == 0 and got.count() == len(ODD)
    back = {(r[0], r[1]) for r in pieces.decode(got).collect()}
    assert back == {(r[0], r[1]) for r in ODD}
    assert pieces.encode(empty).count() == 0


# 6 near duplicates


def shingle_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        same = len(sets[a] & sets[b])
        if 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check_near(df, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_near_duplicates(docs, texts):
    check_near(docs, texts)


def test_near_duplicates_chains_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "CELL", 8)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts, n = {}, 0
    passage = [word() for _ in range(30)]
    for g in range(6):
        base = [word() for _ in range(80)]
        for _ in range(60):  # copies with edits: similarity on both sides of the limit
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts[n] = " ".join(copy)
            n += 1
    for _ in range(80):  # a shared passage alone is no link
        texts[n] = " ".join(passage + [word() for _ in range(rng.randint(5, 60))])
        n += 1
    chain = [word() for _ in range(60)]
    for _ in range(40):
        texts[n] = " ".join(chain)
        chain = chain[2:] + [word(), word()]
        n += 1
    ids = list(texts)
    rng.shuffle(ids)
    texts = {ids[i]: t for i, t in texts.items()}
    check_near(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


def test_near_duplicates_take_few_jobs(spark, docs):
    """Each job, with its plans, costs the driver memory."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    neardup.near_duplicates(docs).collect()
    assert jobs() - before <= 64


@pytest.mark.parametrize("bundle", [3, 1000])
def test_components_of_few_and_many_bundles(spark, monkeypatch, bundle):
    monkeypatch.setattr(neardup, "BUNDLE", bundle)
    rng = random.Random(5)
    name = rng.sample(range(-(1 << 40), 1 << 40), 260)
    links = [(i, i + 1) for i in range(99)] + [(100, i) for i in range(101, 180)] + [(i, i) for i in range(180, 190)]
    links += [(rng.randrange(190, 260), rng.randrange(190, 260)) for _ in range(60)]
    links = [rng.sample((name[a], name[b]), 2) for a, b in links + rng.choices(links, k=40)]
    rng.shuffle(links)
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = neardup.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()
    assert len(got) == len(parent) and dict(map(tuple, got)) == {i: find(i) for i in parent}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_odd(odd, empty):
    got = defaultdict(list)
    for r in neardup.near_duplicates(odd).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(2, 4, True)] * 2 and got[7] == [(2, 4, False)]
    assert sorted(got[None]) == [(0, None, True), (7, None, True)]
    assert got[5][0][0] == 1 and got[6][0][0] == 1
    assert neardup.near_duplicates(empty).count() == 0


# 7 lines


def every_earlier_lines(texts, least=50):
    """Texts without runs of ``least`` words or more that repeat any earlier run of lines."""
    seen, out = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        rows = [(p, x.strip(" \t\r\x0b\x0c"), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for p, x in enumerate(lines)]
        rows = [r for r in rows if r[2]]
        gone = set()
        for k in range(len(rows)):
            n = 0
            for e in range(k, len(rows)):
                n += rows[e][2]
                content = tuple(r[1] for r in rows[k : e + 1])
                if n >= least and content in seen:
                    gone |= set(range(rows[k][0], rows[e][0] + 1))
                elif n >= least:
                    seen.add(content)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def check_lines(df, texts):
    got = {r[0]: r[1] for r in linededup.drop_repeated_lines(df).select("row.doc_id", "text").collect()}
    want = every_earlier_lines(texts)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {} and set(got) == set(want)


def test_line_dedup(docs, texts):
    check_lines(docs, texts)
    assert sum(a != b for a, b in zip(every_earlier_lines(texts).values(), [texts[i] for i in sorted(texts)])) > 10


def test_line_dedup_runs(spark):
    rng = random.Random(2)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 8, 20, 60]))) for _ in range(60)]
    texts = {}
    for i in range(300):
        lines = rng.choices(pool + ["", "  "], k=rng.randint(1, 12))
        if rng.random() < 0.5:
            at = rng.randrange(40)
            lines[rng.randrange(len(lines)) : 0] = pool[at : at + rng.randint(2, 15)]
        if rng.random() < 0.1:
            lines += ["the same line again"] * rng.randint(5, 40)
        texts[i] = "\n".join(lines)
    check_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


def test_line_dedup_odd(odd, empty):
    rows = linededup.drop_repeated_lines(odd).select("row.doc_id", "row.shard", "text").collect()
    assert sorted(map(str, rows)) == sorted(str(r) for r in odd.select("doc_id", "shard", "text").collect())
    assert linededup.drop_repeated_lines(empty).count() == 0


def test_line_dedup_follows_every_earlier_position(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("x", 60), ("y", 30), ("z", 30)))
    three = {1: f"{x}\n{y}", 2: f"{x}\n{z}", 3: f"{x}\n{z}\nend"}
    assert every_earlier_lines(three) == {1: f"{x}\n{y}", 2: z, 3: "end"}
    rng = random.Random(7)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 8, 25, 49, 60, 90]))) for _ in range(30)]
    many = {}
    for i in range(300):
        at = rng.randrange(20)
        lines = pool[at : at + rng.randint(1, 6)] + rng.choices([*pool, "", " "], k=rng.randint(0, 6))
        many[i] = "\n".join(lines + ["again and again"] * rng.choice([0, 0, 0, 30]))
    for texts in (three, many):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        rows = linededup.drop_repeated_lines(df).select("row.doc_id", "text").collect()
        assert {r[0]: r[1] for r in rows} == every_earlier_lines(texts)


def test_line_dedup_overlapping_windows_select_one_line(spark):
    rows = [(1, "\n".join(f"{i} " + "word " * 9 for i in range(40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = linededup.windows(linededup.line_rows(df), 50)
    places = found.groupBy("fingerprint").agg(F.countDistinct("at").alias("n"))
    assert found.count() == 36 and places.filter("n > 1").count() == 0


# 8 mixing


def test_mixing_targets(docs):
    rows = mixing.mix(docs).select("row.source", "size", "source_size", "target", "taken").collect()
    sizes, taken, goal, most = Counter(), Counter(), {}, Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        goal[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
        assert 0 <= r.taken <= 2 * r["size"]
    total = sum(sizes.values())
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-3
    for i, s in enumerate(sorted(sizes)):
        assert goal[s] <= 2 * sizes[s] + 1e-6
        assert abs(taken[s] - goal[s]) <= most[s] / 2 + 1
    free = [s for s in sizes if goal[s] < 2 * sizes[s] - 1e-6]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    assert len({round(goal[s] / weight[s], 3) for s in free}) <= 1


def test_mixing_odd(odd, empty):
    rows = mixing.mix(odd).select("row.doc_id", "row.size", "size", "taken", "target").collect()
    assert len(rows) == len(ODD) and all(0 <= r[3] <= 2 * r[2] for r in rows)
    assert mixing.mix(empty).count() == 0


# 9 rules


def test_rules_ledger(docs, odd, empty):
    rows = rules.ledger(docs)
    each = rules.apply_policy(rows, 3).collect()
    assert all(r.kept == (r.failed == 0) for r in each)
    for r in rules.ablations(rows, 3).collect():
        bit = rules.BIT[r.rule]
        assert r.failing == sum(x.failed & bit != 0 for x in each)
        assert r.only_this == sum(x.failed == bit for x in each)
    got = {r.doc_id: r for r in rules.judge(odd).collect() if r.doc_id is not None}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[5].n_words == 30_000 == got[5].n_repeat_words
    assert rules.judge(empty).count() == 0 and rules.ablations(rules.ledger(empty), 3).count() == 7


def test_rules_keep_clean(docs, labels):
    rows = rules.judge(docs).join(labels, "doc_id").filter("quality = 1 and n_words >= 10").collect()
    assert sum(r.kept for r in rows) / len(rows) > 0.98


def test_repeated_words_with_many_kinds():
    rng = random.Random(3)
    found = [b"%d" % rng.randrange(9000) for _ in range(20_000)]
    found[500:540] = found[100:140]
    found[9000:9007] = found[0:7]
    times = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    hit = set()
    for i in range(len(found) - 4):
        if times[tuple(found[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    assert rules.repeated_words(found) == len(hit)


# the pipeline


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        rows = out.collect()
        seen[name] = rows
        docs = spark.createDataFrame(rows, out.schema)
        if name != "pieces":
            assert out.columns == list(corpus_pipeline.COLUMNS)
    first = {r.doc_id: r.text for r in seen["quality"]}
    assert set(first) < set(texts)
    second = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert second == every_earlier_lines(first)
    near = brute_components(second)
    third = {r.doc_id: r.text for r in seen["near_dedup"]}
    assert third == {i: second[i] for i, (_, c) in near.items() if c == i}
    assert {r.doc_id for r in seen["mixing"]} <= set(third)
    assert Counter(r.doc_id for r in seen["mixing"]) == Counter(r.doc_id for r in seen["pieces"])
    assert all(r.lossless for r in seen["pieces"])


def test_pipeline_odd(spark, odd, empty, tmp_path):
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    for rows in (odd, empty):
        docs = rows
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, str(tmp_path))
            docs = spark.createDataFrame(docs.collect(), docs.schema)
