"""Best-fit packing (operator 3): pieces of documents into as few fixed-length sequences as possible.

Only the number of pieces of each length matters for the packing, and there are
at most ``capacity`` lengths. So the lengths are counted by an aggregate, the
driver packs *kinds* of bins with multiplicities (work and memory do not depend
on the number of documents), and the pieces claim their places by rank within
their length, which is computed in two steps so that a length that a third of
all pieces share is spread over all tasks.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import lookup, map_texts, saved, texts

CAPACITY = 1024
END_ID = 2
PART_ROWS = 100_000  # about as many pieces of one length are numbered together
CACHED_WORDS = 250_000  # a worker remembers the ids of one to two times as many words; some 90 MB at most
CACHED_LENGTH = 48
LATIN_END = "\u0250"  # letters below are letters in every Unicode version
TRAILING = ".,;:!?#$%&*|)"


class WordEncoder:
    """Ids of whole texts as the tokenizer gives them, word by word.

    The byte-level pre-tokenizer always starts a new unit at a space between
    two words, and a line end between two words is a unit of its own, so words
    can be encoded apart and remembered. Texts with other white space, or with
    the start of a special token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.alphabet = "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))
        self.space = self.alphabet[ord(" ")]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.newline = self._encode("\n")
        self.marks = {c: self._encode(c) for c in TRAILING}

    def _encode(self, text: str) -> bytes:
        bare = text[1:] if text[:1] == " " else text
        if bare.isalpha() and (bare.isascii() or max(bare) < LATIN_END):  # one unit of the pre-tokenizer: straight to the merges
            if bare.isascii():
                text = self.space + bare if bare is not text else bare
            else:
                text = text.encode().decode("latin-1").translate(self.alphabet)
            ids = [u.id for u in self.tokenizer.model.tokenize(text)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _alone(self, text: str) -> bytes:
        """A word at the start of a line, or what trails a stem."""
        got = self.starts.get(text)
        if got is None:
            got = self._encode(text) if text else b""
            if len(text) <= CACHED_LENGTH:
                if len(self.starts) >= CACHED_WORDS // 4:
                    self.starts.clear()
                self.starts[text] = got
        return got

    def _word(self, text: str) -> bytes:
        """A word after a space; what was seen before the last ``CACHED_WORDS`` new words is forgotten."""
        mark = self.marks.get(text[-1])
        if mark is not None:  # most words that are not remembered: a remembered one and a mark
            stem = text[:-1]
            got = self.words.get(stem)
            if got is not None and stem[-1].isalnum():
                return got + mark
        got = self.older.get(text)
        if got is None:
            stem = text.rstrip(TRAILING)
            if stem and len(stem) < len(text) and stem[-1].isalnum():  # not remembered itself: the room is better used for stems
                return (self.words.get(stem) or self._word(stem)) + self._alone(text[len(stem) :])
            got = self._encode(" " + text)
        if len(text) <= CACHED_LENGTH:
            if len(self.words) >= CACHED_WORDS:
                self.older, self.words = self.words, {}
            self.words[text] = got
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or "<|" in text or "\n\n" in text or text[0].isspace() or text[-1].isspace() or " \n" in text or "\n " in text or not text.replace("\n", "").isprintable():
            return self._encode(text)
        word, parts = self._word, []
        for line in text.split("\n"):
            words = line.split(" ")
            parts.append(self._alone(words[0]))
            del words[0]
            known = self.words
            parts += [known.get(w) or word(w) for w in words]
            parts.append(self.newline)
        del parts[-1]
        return b"".join(parts)


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


class Lent:
    """An encoder made where it is first used. As a broadcast it lives in a worker as long as the tasks there use it; :func:`load` would hold it, and all words it remembers, through later stages."""

    def __init__(self, path: str):
        self.path = path
        self.encoder: WordEncoder | None = None

    def get(self) -> WordEncoder:
        if self.encoder is None:
            self.encoder = WordEncoder(self.path)
        return self.encoder


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the document's ids and the end id, cut from the back into full pieces."""

    lent = docs.sparkSession.sparkContext.broadcast(Lent(tokenizer_path))

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        encoder, last = lent.value.get(), np.array([end_id], dtype="<u4").tobytes()
        for keys, column in batches:
            out: dict[str, list] = defaultdict(list)
            for key, text in zip(keys.to_pylist(), texts(column), strict=True):
                ids = encoder.encode(text) + last
                n = len(ids) // 4
                at, piece, size = 0, 0, n % capacity or capacity
                while at < n:
                    for name, value in (("doc_id", key), ("piece", piece), ("start", at), ("length", size), ("ids_crc32", zlib.crc32(ids[4 * at : 4 * (at + size)]))):
                        out[name].append(value)
                    at, piece, size = at + size, piece + 1, capacity
            if out:
                yield out

    return map_texts(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long", "doc_id", "text")


# packing kinds of bins ------------------------------------------------------------------------------------------------

EXCHANGES = {(1, 0), (1, 1), (2, 1), (1, 2)}  # how many pieces a bin gets and hands back
Kinds = dict[tuple[int, ...], int]  # lengths in a bin, longest first -> number of such bins


def best_fit(counts: dict[int, int], capacity: int) -> Kinds:
    """Best-fit decreasing over counted lengths: each goes to the fullest bins that still take it."""
    open_bins: dict[int, Counter] = defaultdict(Counter)  # room -> kinds
    done: Counter = Counter()

    def put(kind: tuple[int, ...], room: int, n: int) -> None:
        (open_bins[room] if room else done)[kind] += n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r, kinds in open_bins.items() if kinds and r >= size), default=None)
            kind, n = ((), left) if room is None else next(iter(open_bins[room].items()))
            if room is not None:
                del open_bins[room][kind]
            else:
                room = capacity
            each = min(room // size, left)
            bins = min(n, left // each)
            put(kind + (size,) * each, room - size * each, bins)
            if kind and n > bins:
                put(kind, room, n - bins)
            left -= bins * each
    for kinds in open_bins.values():
        done.update(kinds)
    return dict(done)


def _best_move(a: tuple[int, ...], b: tuple[int, ...], room: int) -> tuple[tuple[int, ...], tuple[int, ...], int] | None:
    """What to hand from the emptier bin ``b`` to ``a`` (and back) so that ``a`` gains most, within its room."""
    best = None
    handed = lambda k: [(x,) for x in dict.fromkeys(k)] + _pairs(k)
    takes = [(), *handed(a)]
    for give in handed(b):
        for take in takes:
            gain = sum(give) - sum(take)
            if 0 < gain <= room and (len(give), len(take)) in EXCHANGES and (best is None or gain > best[2]):
                best = (give, take, gain)
    return best


def _pairs(kind: tuple[int, ...]) -> list[tuple[int, int]]:
    seen = Counter(kind)
    singles = list(seen)
    return [(x, y) for k, x in enumerate(singles) for y in singles[k:] if x != y or seen[x] > 1]


@lru_cache(maxsize=1 << 16)
def _sums(kind: tuple[int, ...]) -> tuple[int, int]:
    """What a bin can hand over, as bits: single lengths, and these with the sums of two of its pieces."""
    one = sum(1 << x for x in set(kind))
    both = one
    for x, y in _pairs(kind):
        both |= 1 << (x + y)
    return one, both


def _can_gain(a: tuple[int, ...], b: tuple[int, ...], least: int, room: int) -> bool:
    """Whether some exchange hands ``a`` more than ``least`` and at most ``room``."""
    if room <= least:
        return False
    window = (1 << (room - least)) - 1
    one, both = _sums(b)
    if one >> (least + 1) & window or any(both >> (t + least + 1) & window for t in set(a)):
        return True
    return any(one >> (t + least + 1) & window for t in {x + y for x, y in _pairs(a)} if t + least < b[0])


def _exchange(now: Counter, a: tuple[int, ...], b: tuple[int, ...], move: tuple) -> list[tuple[int, ...]]:
    """Make the move between as many bins of the two kinds as there are pairs; the kinds that were not there before."""
    give, take, _gain = move
    n = now[a] // 2 if a == b else min(now[a], now[b])
    na, nb = Counter(a), Counter(b)
    na.update(give), na.subtract(take)
    nb.update(take), nb.subtract(give)
    for kind in (a, b):
        now[kind] -= n
        if not now[kind]:
            del now[kind]
    new = []
    for items in (na, nb):
        kind = tuple(sorted(items.elements(), reverse=True))
        if kind:
            if now[kind] < 2:  # not there, or alone until now
                new.append(kind)
            now[kind] += n
    return new


def local_search(kinds: Kinds, capacity: int) -> Kinds:
    """Move documents, swap one for one or two for one between underfull bins until no exchange raises the sum of squared fills.

    Handing ``g`` from a bin to one that is fuller than it by ``d`` (or emptier,
    by ``-d``) raises the sum if ``g + d > 0``; the sum is a bounded integer, so
    the search ends. Equal bins change together. Rounds that feed the fullest
    underfull bins from the emptiest do most of the work; then every kind meets
    every other one, the emptiest first, and whatever an exchange makes meets
    all again.
    """
    now = Counter(kinds)
    changed = True
    while changed:
        under = sorted((k for k in now if sum(k) < capacity), key=sum, reverse=True)
        lo, hi, changed = 0, len(under) - 1, False
        while lo < hi:
            a, b = under[lo], under[hi]
            room = capacity - sum(a)
            move = _best_move(a, b, room) if _can_gain(a, b, 0, room) else None
            if move is None:
                lo += 1
                continue
            _exchange(now, a, b, move)
            changed = True
            lo += a not in now
            hi -= b not in now
    fill = {k: sum(k) for k in now}
    fresh = [(-fill[k], k) for k in now if fill[k] < capacity]
    heapify(fresh)
    while fresh:
        _, x = heappop(fresh)
        for y in sorted((k for k in now if fill[k] < capacity), key=fill.__getitem__):
            while x in now and y in now and (x != y or now[x] > 1):
                for a, b in ((x, y), (y, x)):
                    least, room = max(0, fill[b] - fill[a]), capacity - fill[a]
                    if _can_gain(a, b, least, room):
                        for kind in _exchange(now, a, b, _best_move(a, b, room)):
                            fill[kind] = sum(kind)
                            if fill[kind] < capacity:
                                heappush(fresh, (-fill[kind], kind))
                        break
                else:
                    break
            if x not in now:
                break
    return dict(now)


def places(kinds: Kinds) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, ranks, pieces per bin, first sequence, offset)`` that tell each rank of a length its place."""
    runs, rank, base = [], Counter(), 0
    for kind, n in sorted(kinds.items(), reverse=True):
        offset = 0
        for length, each in Counter(kind).items():
            runs.append((length, rank[length], n * each, each, base, offset))
            rank[length] += n * each
            offset += length * each
        base += n
    return runs


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and offset there.

    A null or empty text is one piece that holds just the end id. Repeated rows
    are packed once each. Other columns are ignored. An empty table gives no
    sequence.
    """
    spark = docs.sparkSession
    pieces = saved(cut_documents(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = places(local_search(best_fit(counts, capacity), capacity))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    parts = F.lit([-(-counts.get(size, 0) // PART_ROWS) or 1 for size in range(capacity + 1)])  # by length: a hot one is numbered in many parts
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(parts, F.col("length").cast("int"))).cast("int")
    dealt = pieces.withColumn("part", part)
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = saved(sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), "offsets")  # one row per length and part
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1
    ranked = lookup(dealt.withColumn("local", rank), offsets, ["length", "part"], "inner").withColumn("rank", F.col("before") + F.col("local"))
    # kinds of bins are bounded by the number of lengths, not of documents: a broadcast of fixed size;
    # as an Arrow table, since a list of rows would start a second Python daemon in each executor, which stays
    names = ["run_length", "first", "ranks", "each", "base", "at"]
    where = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*runs, strict=True) if runs else [()] * len(names))], names=names))
    hit = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    step = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(where), hit).select(
        *(c for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
        (F.col("base") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (step % F.col("each")) * F.col("length")).alias("offset"),
    )
