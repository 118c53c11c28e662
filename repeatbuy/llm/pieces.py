"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The vocabulary is of the merge kind: a piece's score is its rank among merges, so of all ways to cut
a text one is consistent, where no two neighbours would have been merged across their border. That
holds pair by pair. So the search keeps, for every prefix, the last piece of its one consistent path
and extends it by a piece whose pair with that last one holds. Only a window of the longest piece is
looked at; when the paths of all prefixes in the window meet at one border, the ids before it are
final, are given out and forgotten. No piece crosses from a letter into a space mark, so all paths
meet before every space, and words found before are read from a bounded cache. What the search finds
for a prefix hangs on the prefix alone, so words that start alike share their first steps.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatbuy.llm.common import by_value, map_slices

by_value(__name__)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHED = 800_000  # pairs
CACHED_CHARS = 64
ROOM = 96 << 20  # bytes of the chunks kept with their ids, however long these are
SLOT = 48  # bytes of an entry beside its key and value
HEAD = 8  # characters of a chunk's start whose search is kept for other chunks
HEADS = 300_000


def load(path: str = MODEL) -> dict:
    """Pieces of a model file, read on the driver: strings with rank and id, byte ids, all pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain, byte_ids, text = {}, {}, []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            text.append(b"")
        else:
            plain[piece] = (model.get_score(i), i)
            text.append(piece.encode())
    return {
        "plain": plain,
        "bytes": byte_ids if len(byte_ids) == 256 else {},
        "unknown": model.unk_id(),
        "text": text,
    }


class Codec:
    def __init__(self, model: dict):
        self.plain, self.bytes = model["plain"], model["bytes"]
        self.unknown, self.text = model["unknown"], model["text"]
        self.longest = max(map(len, self.plain), default=1)
        # Caches live with the model: a worker keeps a broadcast value from task to task.
        self.pairs: dict[str, dict[str, bool]] = model.setdefault("pairs", {})  # by left, by right piece
        self.tested = sum(map(len, self.pairs.values()))
        self.split: dict[str, tuple[str, ...]] = model.setdefault("split", {})
        self.model = model
        self.known: dict[str, bytes] = model.setdefault("known", {})
        self.older: dict[str, bytes] = model.setdefault("older", {})
        self.used = sum(getsizeof(c) + getsizeof(ids) + SLOT for c, ids in self.known.items())
        self.heads: dict[str, str] = model.setdefault("heads", {})  # last piece by prefix
        self.code = "H" if len(self.text) <= 1 << 16 else "i"  # of packed ids, for array and numpy
        self.raw: dict[str, bytes] = model.setdefault("raw", {})
        if not self.raw:
            self.raw.update((p, array(self.code, [i]).tobytes()) for p, (_, i) in self.plain.items())
        # Pieces of two characters or more by their characters from the end on; "" holds the piece.
        self.ends: dict = model.setdefault("ends", {})
        if not self.ends:
            for p in self.plain:
                if len(p) > 1:
                    node = self.ends
                    for c in reversed(p):
                        node = node.setdefault(c, {})
                    node[""] = p
        crosses = any(SPACE in p.lstrip(SPACE) for p in self.plain)
        # Spaces stand for space marks until a chunk is searched: plain words are kept in half the room.
        self.chunk = re.compile(".+" if crosses else f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+", re.S)

    def holds(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters by rank ends in just these two pieces."""
        known = self.pairs.get(left)
        if known is None:
            known = self.pairs[left] = {}
        hit = known.get(right)
        if hit is None:
            if self.tested >= CACHED:
                self.pairs.clear()
                self.tested, known = 0, self.pairs.setdefault(left, {})
            hit = known[right] = self.merged(left, right)
            self.tested += 1
        return hit

    def halves(self, piece: str) -> tuple[str, ...] | None:
        """The two parts whose merge, the last one by rank, makes the piece; None for a character, and
        nothing for a piece that merging never ends in."""
        if len(piece) < 2:
            return None
        hit = self.split.get(piece)
        if hit is None:
            none = (-np.inf,)
            parts, hit = list(piece), ()
            scores = [self.plain.get(a + b, none)[0] for a, b in zip(parts, parts[1:])]
            while scores and (best := max(scores)) > -np.inf:
                at = scores.index(best)
                hit = parts[at], parts[at + 1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del scores[at]
                if at:
                    scores[at - 1] = self.plain.get(parts[at - 1] + parts[at], none)[0]
                if at < len(scores):
                    scores[at] = self.plain.get(parts[at] + parts[at + 1], none)[0]
            hit = hit if len(parts) == 1 else ()
            if len(self.split) >= CACHED:
                self.split.clear()
            self.split[piece] = hit
        return hit

    def merged(self, left: str, right: str) -> bool:
        """Whether merging by rank, best first and leftmost among equals, never joins a part of
        ``left`` to a part of ``right``.

        Merges are taken back, the latest first, while looking at the two parts that meet at the
        border: they would have been joined if their merge came before the one just taken back.
        """
        a, b = self.halves(left), self.halves(right)
        if a == () or b == ():
            return False
        if not left:
            return True
        plain, none = self.plain, (-np.inf,)
        limit, first = -np.inf, True  # a merge of this score goes first if it is equal, too
        while True:
            over = plain.get(left + right, none)[0]
            if over > limit or (first and over == limit and over > -np.inf):
                return False
            if a is None and b is None:
                return True
            # The lower score was merged later; among equals the right one was.
            if b is None or (a is not None and plain[left][0] < plain[right][0]):
                limit, first, left = plain[left][0], False, a[1]
                a = self.halves(left)
            else:
                limit, first, right = plain[right][0], True, b[0]
                b = self.halves(right)

    def pieces(self, chars: str) -> Iterator[list[str]]:
        """Pieces of a text in order, given out in lists once no path can change them."""
        pairs, holds, ends_in = self.pairs, self.holds, self.ends.get
        base = done = 0  # border up to which pieces are out, and up to which prefixes are searched
        last = [""]  # last piece of each prefix from base on; empty: no path
        ends = len(chars)
        look = 4 * self.longest
        head, heads = min(HEAD, ends, look), self.heads
        while done < head and (found := heads.get(chars[: done + 1])) is not None:
            last.append(found)
            done += 1
        if done < head and len(heads) >= HEADS:
            heads.clear()
        fresh = range(done + 1, head + 1)
        while done < ends:
            stop = min(base + look, ends)
            for i in range(done + 1, stop + 1):
                found = ""
                room = i - base
                char = chars[i - 1]
                node, at = ends_in(char), i - 1
                fitting = [char]  # a character is a piece, known or not
                while node is not None and at > base:
                    at -= 1
                    node = node.get(chars[at])
                    if node is not None and "" in node:
                        fitting.append(node[""])
                while fitting:  # the longest first
                    piece = fitting.pop()
                    k = len(piece)
                    left = last[room - k]
                    if left or k == room:
                        known = pairs.get(left)
                        hit = None if known is None else known.get(piece)
                        if hit is None:
                            hit = holds(left, piece)
                        if hit:
                            found = piece
                            break
                last.append(found)
            done = stop
            for i in fresh:
                heads[chars[:i]] = last[i]
            fresh = ()
            if done < ends:
                border = self.meeting(last, done - base)
                if border > 1:
                    # The piece before the border stays in the window: the next pair needs it.
                    keep = border - len(last[border])
                    yield self.path(last, keep)
                    base, last = base + keep, ["", *last[keep + 1 :]]
                look = (done - base) + 2 * self.longest
        yield self.path(last, ends - base)

    def meeting(self, last: list[str], end: int) -> int:
        """The last border that the paths of all prefixes in the window share."""
        heads = {j for j in range(max(0, end - self.longest + 1), end + 1) if last[j]}
        while len(heads) > 1:
            far = max(heads)
            heads.remove(far)
            heads.add(far - len(last[far]))
        return heads.pop() if heads else 0

    @staticmethod
    def path(last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def ids(self, piece: str) -> bytes:
        """Packed ids of a piece."""
        found = self.plain.get(piece)
        if found is not None:
            return array(self.code, [found[1]]).tobytes()
        if self.bytes:
            return array(self.code, [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]).tobytes()
        return array(self.code, [self.unknown]).tobytes()

    def searched(self, chunk: str) -> bytes:
        """Packed ids of a chunk; short chunks go to the cache, whose older half is forgotten when full."""
        hit = self.known.get(chunk)  # found since the text's chunks were looked up
        if hit is not None:
            return hit
        hit = self.older.get(chunk)
        if hit is None:
            raw = self.raw
            out = []
            for pieces in self.pieces(chunk.replace(" ", SPACE)):
                for piece in pieces:
                    out.append(raw.get(piece) or self.ids(piece))
            hit = b"".join(out)
        if len(chunk) <= CACHED_CHARS:
            if self.used >= ROOM // 2:
                self.older = self.model["older"] = self.known
                self.known = self.model["known"] = {}
                self.used = 0
            self.known[chunk] = hit
            self.used += getsizeof(chunk) + getsizeof(hit) + SLOT
        return hit

    def packed(self, text: str) -> np.ndarray:
        """Ids of a text as 32-bit numbers."""
        chunks = self.chunk.findall(" " + text) if text else []
        out = list(map(self.known.get, chunks))
        if None in out:
            out = [self.searched(c) if hit is None else hit for hit, c in zip(out, chunks)]
        return np.frombuffer(b"".join(out), self.code).astype(np.int32)

    def encode(self, text: str | None) -> list[int] | None:
        return None if text is None else self.packed(text).tolist()

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text.replace(SPACE, " ").removeprefix(" ")


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids and whether decoding the ids gives the text again, of every row.

    Null texts have null ids, empty texts none; a text that holds the space mark itself decodes to
    a space there and is not lossless. Repeated rows are encoded each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def make():
        codec = Codec(shared.value)

        def step(cols):
            ids = [None if t is None else codec.packed(t) for t in cols["text"]]
            back = [None if i is None else codec.decode(i.tolist()) for i in ids]
            return {
                "doc_id": cols["doc_id"],
                "ids": ids,
                "n_ids": [None if i is None else len(i) for i in ids],
                "lossless": [b == t for b, t in zip(back, cols["text"], strict=True)],
            }

        return step

    return map_slices(
        docs.select(F.col("doc_id").cast("long"), "text"),
        make,
        "doc_id long, ids array<int>, n_ids long, lossless boolean",
    )


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))

    def make():
        codec = Codec(shared.value)
        return lambda c: {"doc_id": c["doc_id"], "text": [codec.decode(i) for i in c["ids"]]}

    return map_slices(rows.select("doc_id", "ids"), make, "doc_id long, text string")
