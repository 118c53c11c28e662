"""Repeated strings of LENGTH bytes across documents, by prefix-free parsing.

Triggers, strings of WORD bytes whose rolling hash is small, cut texts into phrases that overlap by a
trigger. Which triggers lie in a string of LENGTH bytes depends on its bytes alone, so equal strings
hold equal phrases; a string's key is the longest phrase inside it. Neighbouring strings with one key
form a run, and the text under a run is an entry of the dictionary. The parse is the list of runs.

1. The parse is sorted by phrase, entry and place in the corpus. A run whose entry came earlier is a
   repeat as a whole. Of the others only those matter whose phrase has another entry too.
2. The text of these dictionary entries is fetched, and a suffix array over the entries of a stretch
   of phrases orders all strings that start in them. Equal strings come in the order of the parse, so
   all but the first one are repeats.
3. Phrases that span partitions or stretches, frequent ones, hand on their entries. These are sorted
   by what follows and by what comes before the phrase; strings that reach no further than an entry
   has in common with its neighbours meet by two hashes of 64 bits.

Highly repetitive text shrinks to its dictionary in the first step: no string of a copy is looked at
again. The whole corpus order is never written out; only phrases with several entries need it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.functions.skew import shuffle_width
from repeatbuy.llm.common import by_value
from repeatbuy.plans.staging import stage, stage_bucketed

by_value(__name__)

LENGTH = 100
WORD = 8
EVERY = 12  # a string is a trigger once in so many, by its hash
SLICE = 1 << 18  # bytes of text parsed at once
STRETCH = 1 << 20  # bytes of dictionary sorted at once
LAST = (1 << 63) - 1
COUNT = 1 << 7  # of a run: its strings, fewer than LENGTH, and COUNT times the phrase's place in it
RUNS = "phrase long, entry long, doc long, row long, at int, n int"
#: Odd multipliers of the two rolling hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@functools.cache
def powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each byte, and the powers of the factor and of its inverse."""
    words = np.random.default_rng(which).integers(0, 1 << 64, 256, dtype=np.uint64)
    factor, inverse = FACTORS[which], pow(FACTORS[which], -1, 1 << 64)
    rise = np.cumprod(np.r_[np.uint64(1), np.full(size, factor, np.uint64)])
    fall = np.cumprod(np.r_[np.uint64(1), np.full(size, inverse, np.uint64)])
    return words, rise, fall


class Rolling:
    """Hashes of any substring from sums over prefixes."""

    def __init__(self, text: np.ndarray, which: int):
        words, rise, self.fall = powers(which, max(SLICE + LENGTH, 1 << max(len(text), 1).bit_length()))
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(words[text] * rise[: len(text)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.fall[start]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` whole numbers from each ``start`` on."""
    if not len(start):
        return np.zeros(0, np.int64)
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


# --- the parse -------------------------------------------------------------------------------


def keys(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the pieces ``start`` to ``stop`` of a text: piece, first place, number of strings, place
    of the phrase after the first, hash of the phrase and of the entry. A string without a whole phrase
    inside is a run of its own, and its own phrase."""
    one, two = Rolling(text, 0), Rolling(text, 1)
    n = len(text)
    at = np.arange(max(0, n - WORD + 1))
    trigger = np.flatnonzero(one.of(at, at + WORD) < np.uint64((1 << 64) // EVERY))
    first, last = trigger[:-1], trigger[1:] + WORD  # of phrases
    size = last - first
    weight = np.where(size <= LENGTH, (np.minimum(size, LENGTH).astype(np.uint64) << np.uint64(57)) | (one.of(first, last) >> np.uint64(7)), np.uint64(0))

    # The phrases inside a string change only where it loses its first or gains a last one.
    edges = np.unique(np.concatenate([start, np.maximum(stop - LENGTH + 1, start), first + 1, last - LENGTH]))
    edges = edges[(edges >= 0) & (edges < n)]
    upto = np.r_[edges[1:], n]
    piece = np.searchsorted(start, edges, side="right") - 1
    fits = (piece >= 0) & (edges + LENGTH <= stop[piece])
    edges, upto, piece = edges[fits], upto[fits], piece[fits]
    low = np.searchsorted(first, edges)
    high = np.searchsorted(last, edges + LENGTH, side="right") - 1
    held = high >= low

    # The heaviest of phrases low to high, the earlier one of equals, from tables of powers of two.
    best = np.full(len(edges), -1)
    if held.any():
        span = high - low + 1
        level = np.where(held, np.log2(np.maximum(span, 1)).astype(np.int64), 0)
        row = np.arange(len(first))
        for k in range(int(level.max()) + 1):
            now = np.flatnonzero(held & (level == k))
            a, b = row[low[now]], row[high[now] - (1 << k) + 1]
            best[now] = np.where(weight[b] > weight[a], b, a)
            a, b = row[: max(0, len(row) - (1 << k))], row[1 << k :]
            row = np.where(weight[b] > weight[a], b, a)

    new = np.ones(len(edges), bool)
    new[1:] = (best[1:] != best[:-1]) | (piece[1:] != piece[:-1]) | (edges[1:] != upto[:-1])
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(edges)] - 1 if len(edges) else head
    at, n_at, best, piece = edges[head], upto[tail] - edges[head], best[head], piece[head]
    bare = best < 0
    alone = ranges(at[bare], n_at[bare])
    begin = np.r_[at[~bare], alone]
    count = np.r_[n_at[~bare], np.ones(len(alone), np.int64)]
    piece = np.r_[piece[~bare], np.repeat(piece[bare], n_at[bare])]
    phrase = np.r_[one.of(first[best[~bare]], last[best[~bare]]), one.of(alone, alone + LENGTH)]
    lead = np.r_[first[best[~bare]] - at[~bare], np.zeros(len(alone), np.int64)]
    return piece, begin, count, lead, phrase.view(np.int64), two.of(begin, begin + count + LENGTH - 1).view(np.int64)


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Neighbouring texts of about SLICE bytes, longer ones in pieces that overlap by LENGTH - 1:
    bytes, row of each piece, its start and stop in them, and its start in the text."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        begin = offsets[at]
        stop = max(at + 1, int(np.searchsorted(offsets, begin + SLICE, side="right")) - 1)
        size = int(offsets[stop] - begin)
        if size <= SLICE:
            rows = np.arange(at, stop)
            bounds = offsets[at : stop + 1] - begin
            yield data[begin : begin + size], rows, bounds[:-1], bounds[1:], np.zeros(len(rows), np.int64)
        else:  # one long text
            for cut in range(0, size - LENGTH + 1, SLICE - LENGTH + 1):
                piece = data[begin + cut : begin + min(size, cut + SLICE)]
                one = np.array([len(piece)])
                yield piece, np.array([at]), np.zeros(1, np.int64), one, np.array([cut])
        at = stop


def merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals that touch or overlap within an owner, joined; given by owner and start."""
    if not len(start):
        return owner, start, stop
    reach = stop.copy()
    group = np.cumsum(np.r_[True, owner[1:] != owner[:-1]])
    reach = np.maximum.accumulate(reach + group * (1 << 40)) - group * (1 << 40)
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])])
    return owner[new], start[new], reach[np.r_[new[1:], len(start)] - 1]


def parse(docs: DataFrame) -> DataFrame:
    """Runs of all texts. A run whose entry comes earlier in its own text is a repeat already; such
    runs are joined to intervals, with ``n`` as their length below zero."""

    def run(batches):
        for batch in batches:
            doc, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            for text, rows, start, stop, moved in slices(batch.column("text")):
                piece, at, n, lead, phrase, entry = keys(text, start, stop)
                order = np.lexsort((at, entry, phrase, piece))
                piece, at, n, lead, phrase, entry = (x[order] for x in (piece, at, n, lead, phrase, entry))
                again = np.zeros(len(at), bool)
                again[1:] = (piece[1:] == piece[:-1]) & (phrase[1:] == phrase[:-1]) & (entry[1:] == entry[:-1])
                by = np.lexsort((at[again], piece[again]))
                owner, low, high = merged(piece[again][by], at[again][by], (at + n + LENGTH - 1)[again][by])
                piece = np.r_[piece[~again], owner]
                at = np.r_[at[~again], low]
                n = np.r_[(n + COUNT * lead)[~again], low - high]
                # Intervals have no phrase; a hash of their place deals them out evenly.
                spread = (row[rows[owner]] + low).astype(np.uint64) * np.uint64(FACTORS[0])
                phrase, entry = np.r_[phrase[~again], spread.view(np.int64)], np.r_[entry[~again], np.zeros(len(owner), np.int64)]
                source = rows[piece]
                at = at - start[piece] + moved[piece]
                columns = [phrase, entry, doc[source], row[source], at.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["phrase", "entry", "doc", "row", "at", "n"])

    return docs.select("doc", "row", "text").mapInArrow(run, RUNS)


def sorted_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in order over all partitions; a frequent phrase spreads over several."""
    return rows.repartitionByRange(shuffle_width(rows.sparkSession), *columns).sortWithinPartitions(*columns)


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Rows ``again``: runs (or intervals, with ``n`` below zero) that are repeats as a whole; and
    runs whose phrase has, or may have in another partition, a second entry."""

    def run(batches):
        names = ["again", "phrase", "doc", "row", "at", "n"]
        held = None  # the last first run of an entry, its fate still open
        key = (None, None)  # of the last run
        started = False

        def out(again, part):
            part = part.combine_chunks() if isinstance(part, pa.Table) else pa.Table.from_batches([part])
            flag = pa.array(np.full(part.num_rows, again))
            yield from part.select(names[1:]).add_column(0, "again", flag).to_batches()

        for batch in batches:
            n = batch.column("n").to_numpy()
            phrase, entry = batch.column("phrase").to_numpy(), batch.column("entry").to_numpy()
            local = n < 0
            if local.any():
                yield from out(True, batch.filter(pa.array(local)))
                batch = batch.filter(pa.array(~local))
                phrase, entry = phrase[~local], entry[~local]
            if not len(phrase):
                continue
            same = np.r_[key == (phrase[0], entry[0]), (phrase[1:] == phrase[:-1]) & (entry[1:] == entry[:-1])]
            key = (phrase[-1], entry[-1])
            yield from out(True, batch.filter(pa.array(same)))
            fresh = batch.filter(pa.array(~same))
            if not fresh.num_rows:
                continue
            table = pa.Table.from_batches(([held[0]] if held else []) + [fresh])
            p = table.column("phrase").to_numpy()
            twin = np.zeros(len(p), bool)
            twin[1:] |= p[1:] == p[:-1]
            twin[:-1] |= p[1:] == p[:-1]
            twin[0] |= held[1] if held else not started
            started = True
            yield from out(False, table.slice(0, len(p) - 1).filter(pa.array(twin[:-1])))
            held = (table.slice(len(p) - 1).combine_chunks().to_batches()[0], bool(twin[-1]))
        if held:
            yield from out(False, held[0])

    order = ("phrase", "entry", "doc", "row", "at")
    return sorted_by(runs, *order).mapInArrow(run, "again boolean, phrase long, doc long, row long, at int, n int")


# --- the dictionary --------------------------------------------------------------------------


def fetched(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """phrase, doc, row, at, bytes and place of the phrase of the runs asked for, from their documents."""
    wanted = asked.groupBy("row").agg(F.collect_list(F.struct("phrase", "at", "n")).alias("runs"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for i in range(batch.num_rows):
                text, runs = texts[i].as_buffer(), batch.column("runs")[i].values
                phrase, at, n = (runs.field(c) for c in ("phrase", "at", "n"))
                n = n.to_numpy()
                cuts = [text.slice(a, m).to_pybytes() for a, m in zip(at.to_pylist(), (n % COUNT + LENGTH - 1).tolist(), strict=True)]
                lead = pa.array(n // COUNT)
                doc, row = (pa.array(np.full(len(runs), batch.column(c)[i].as_py())) for c in ("doc", "row"))
                yield pa.RecordBatch.from_arrays(
                    [phrase, doc, row, at, lead, pa.array(cuts, pa.binary())], names=["phrase", "doc", "row", "at", "lead", "text"]
                )

    joined = docs.join(wanted, "row").select("doc", "row", "text", "runs")
    return joined.mapInArrow(run, "phrase long, doc long, row long, at int, lead int, text binary")


def suffix_ranks(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The rank of every suffix by its first ``depth`` bytes (16 at least), equal for equal ones:
    words of eight bytes are ranked, and ranks of twice the length made from pairs."""
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    word = np.zeros(len(text), np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i : i + len(text)]
    rank, known = np.unique(word, return_inverse=True)[1].astype(np.uint64) + np.uint64(1), 8
    while known < depth:
        step = min(known, depth - known)
        ahead = np.r_[rank[step:], np.zeros(min(step, len(rank)), np.uint64)]
        rank = np.unique(rank << np.uint64(32) | ahead, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        known += step
    return rank


def later_strings(cuts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all strings that start in these entries, given in the order of the parse: their entry, their
    place in it, and whether an equal one comes before."""
    sizes = np.array([len(x) for x in cuts.to_pylist()], np.int64)
    text = np.frombuffer(b"".join(cuts.to_pylist()), np.uint8)
    start = np.r_[0, np.cumsum(sizes)[:-1]]
    count = sizes - LENGTH + 1
    place = ranges(start, count)
    owner = np.repeat(np.arange(len(sizes)), count)
    _, first, of = np.unique(suffix_ranks(text)[place], return_index=True, return_inverse=True)
    return owner, place - start[owner], first[of] != np.arange(len(place))


OPEN = "phrase long, doc long, row long, at int, ahead binary, behind binary, open binary"


def resolved(entries: DataFrame) -> DataFrame:
    """Repeated intervals (row, start, stop); and entries of phrases that go on in another stretch or
    partition: their text from the phrase on, the text before it backwards, and a byte for each of
    their strings, 1 where no equal one came before."""
    schema = OPEN + ", start int, stop int"
    names = ["phrase", "doc", "row", "at", "ahead", "behind", "open", "start", "stop"]
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.binary()] * 3 + [pa.int32()] * 2

    def out(table: pa.Table, shared: np.ndarray):
        owner, inside, later = later_strings(table.column("text").combine_chunks())
        row, at = (table.column(c).to_numpy() for c in ("row", "at"))
        begin = at[owner].astype(np.int64) + inside
        of, low, high = merged(owner[later], begin[later], begin[later] + LENGTH)
        spans = {"row": row[of], "start": low, "stop": high}
        yield pa.RecordBatch.from_arrays(
            [pa.array(spans[c], k) if c in spans else pa.nulls(len(of), k) for c, k in zip(names, kinds, strict=True)], names=names
        )
        ask = np.unique(owner[~later & shared[owner]])
        if not len(ask):
            return
        bounds = np.searchsorted(owner, np.r_[ask, ask + 1]).reshape(2, -1).T
        flags = (~later).astype(np.uint8)
        part = table.take(pa.array(ask)).to_pydict()
        cuts = list(zip(part["text"], part["lead"], strict=True))
        made = {c: part[c] for c in ("phrase", "doc", "row", "at")} | {
            "ahead": [text[lead:] for text, lead in cuts],
            "behind": [text[:lead][::-1] for text, lead in cuts],
            "open": [flags[a:b].tobytes() for a, b in bounds.tolist()],
        }
        yield pa.RecordBatch.from_arrays(
            [pa.array(made[c], k) if c in made else pa.nulls(len(ask), k) for c, k in zip(names, kinds, strict=True)], names=names
        )

    def run(batches):
        held, size, first, carried = [], 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("text").nbytes
            if first is None:
                first = batch.column("phrase")[0].as_py()
            if size < STRETCH:
                continue
            table = pa.Table.from_batches(held)
            phrase = table.column("phrase").to_numpy()
            keep = int(np.searchsorted(phrase, phrase[-1]))  # the last phrase may go on
            keep = keep if keep else len(phrase)
            part = table.slice(0, keep)
            phrase = phrase[:keep]
            yield from out(part, (phrase == first) | (phrase == carried) | (keep == table.num_rows))
            carried = int(phrase[-1]) if keep == table.num_rows else None
            rest = table.slice(keep)
            held, size = rest.to_batches(), rest.column("text").nbytes
        if held and sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            phrase = table.column("phrase").to_numpy()
            yield from out(table, (phrase == first) | (phrase == carried) | (phrase == phrase[-1]))

    return sorted_by(entries, "phrase", "doc", "row", "at").mapInArrow(run, schema)


def common(phrase: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each of these texts, in order, the bytes at its start that a neighbour of its phrase shares;
    all of them for the first and last one, whose neighbours may lie elsewhere."""
    size = np.array([len(x) for x in texts], np.int64)
    wide = int(size.max(initial=1)) or 1
    grid = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in texts), np.uint8).reshape(-1, wide)
    differ = np.c_[grid[1:] != grid[:-1], np.ones((len(texts) - 1, 1), bool)].argmax(1)
    shared = np.where(phrase[1:] == phrase[:-1], np.minimum(differ, np.minimum(size[1:], size[:-1])), 0)
    reach = np.maximum(np.r_[size[0], shared], np.r_[shared, size[-1]])
    return np.minimum(reach, size)


def shared_strings(entries: DataFrame) -> DataFrame:
    """Two hashes, doc, row and start of the open strings that another entry of the phrase may hold.

    In the order of the text from the phrase on, the neighbours of an entry share most with it, and so
    they do in the order of the text before the phrase. A string that reaches further than either
    occurs nowhere else. Both orders are kept over all partitions.
    """

    def ahead(batches):
        for batch in batches:
            if batch.num_rows:
                reach = common(batch.column("phrase").to_numpy(), batch.column("ahead").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach, pa.int32())], names=[*batch.schema.names, "reach"])

    def strings(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            behind, front = batch.column("behind").to_pylist(), batch.column("ahead").to_pylist()
            back = common(batch.column("phrase").to_numpy(), behind)
            lead = np.array([len(x) for x in behind], np.int64)
            size = lead + np.array([len(x) for x in front], np.int64)
            text = np.frombuffer(b"".join(b[::-1] + a for b, a in zip(behind, front, strict=True)), np.uint8)
            flags = np.frombuffer(b"".join(batch.column("open").to_pylist()), np.uint8) == 1
            owner = np.repeat(np.arange(len(size)), size - LENGTH + 1)
            inside = ranges(np.zeros(len(size), np.int64), size - LENGTH + 1)
            before = lead[owner] - inside
            fine = flags & (before <= back[owner]) & (LENGTH - before <= batch.column("reach").to_numpy()[owner])
            owner, inside = owner[fine], inside[fine]
            place = (np.cumsum(size) - size)[owner] + inside
            hashes = [Rolling(text, k).of(place, place + LENGTH).view(np.int64) for k in (0, 1)]
            doc, row, at = (batch.column(c).to_numpy()[owner] for c in ("doc", "row", "at"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*hashes, doc, row, (at + inside).astype(np.int32))], names=["one", "two", "doc", "row", "start"]
            )

    front = sorted_by(entries, "phrase", "ahead", "row", "at").mapInArrow(ahead, OPEN + ", reach int")
    return sorted_by(front, "phrase", "behind", "row", "at").mapInArrow(strings, "one long, two long, doc long, row long, start int")


# --- documents -------------------------------------------------------------------------------


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay) and spans (start and stop of what is removed).

    A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a smaller doc_id,
    or earlier in the same text. Strings are judged on the texts as given and never cross texts.
    Rows without an id come after all others; rows that share an id, or have none, come in the order
    in which the table is read, and a repeated row is a text of its own. A null text counts as empty;
    texts shorter than LENGTH stay as they are. Nothing is collected.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage_bucketed(rows, "texts", ["row"], shuffle_width(spark))
    runs = stage(repeated_runs(parse(rows)), "runs")
    entries = stage(fetched(rows, runs.filter("not again")), "entries")
    found = stage(resolved(entries), "resolved")
    open_entries = found.filter("open is not null").drop("start", "stop")
    strings = stage(shared_strings(open_entries), "strings")
    place = F.struct("doc", "row", "start")
    firsts = strings.groupBy("one", "two").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1").select("one", "two", "first")
    later = strings.join(firsts, ["one", "two"]).filter(place > F.col("first"))
    later = later.select("row", "start", (F.col("start") + LENGTH).alias("stop"))
    stop = F.when(F.col("n") < 0, F.col("at") - F.col("n")).otherwise(F.col("at") + F.col("n") % COUNT + LENGTH - 1)
    whole = runs.filter("again").select("row", F.col("at").alias("start"), stop.cast("int").alias("stop"))
    marks = whole.union(found.filter("open is null").select("row", "start", "stop")).union(later)
    marks = marks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("marks"))

    def run(batches):
        for batch in batches:
            texts, marks = batch.column("text").cast(pa.large_binary()), batch.column("marks")
            sizes, kept, spans = [], [], []
            for i in range(batch.num_rows):
                text, found = texts[i].as_py(), marks[i].values
                low, high = (found.field(c).to_numpy() if found else np.zeros(0, np.int64) for c in ("start", "stop"))
                _, low, high = merged(np.zeros(len(low), np.int64), low.astype(np.int64), high.astype(np.int64))
                low, high = low.tolist(), high.tolist()
                sizes.append(len(text))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *high], [*low, len(text)], strict=True)))
                spans.append([{"start": a, "stop": b} for a, b in zip(low, high, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["doc_id", "n_bytes", "kept", "spans"],
            )

    joined = rows.join(marks, "row", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, stop: long>>")
