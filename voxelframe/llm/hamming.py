"""SimHash near-duplicates (operator 9) by anchor points of a covering code.

Fingerprints of 64 bits link at 4 or fewer differing bits. Two such fingerprints
differ in at most 2 bits in one of their 32-bit halves, so each half is covered
on its own: its anchors are the words of the perfect Hamming code [31, 26] with
the last bit free, every 32-bit word being within one bit (the covering radius)
of an anchor. The word halfway between two halves that are 2 bits apart is one
bit (the threshold of each side) from both, and within the covering radius of an
anchor; so both halves lie within radius plus threshold, 2 bits, of this anchor.
Every fingerprint is copied to all anchors within 2 bits of each half (33 copies
on average, of 2**28 anchors), and only fingerprints that share an anchor are
compared, in full. No link can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import bounded, in_blocks, lean, lookup, map_texts, saved, utf8, whole_groups
from voxelframe.llm.components import components, forest

SEED = 42
BITS = 64
THRESHOLD = 4
SHINGLE = 4
BLOCK = 4096  # fingerprints of one anchor that are compared as one unit

# simhash --------------------------------------------------------------------------------------------------------------


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Majority of the bits of XXH64 over word shingles; fewer words than a shingle are one; no words give 0."""
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=">u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 60_000):
        part = h[k : k + 60_000]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big")


def split_words(text: bytes) -> list[bytes]:
    """Words between spaces and the control characters 9 to 13, A to Z in lower case."""
    return text.lower().split()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(id, mark, fp)`` per row: the column ``__mark`` of the input (null without one) and the fingerprint as a signed LONG; a null text counts as empty. Narrow."""

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for keys, marks, column in batches:
            yield {"id": keys, "mark": marks, "fp": np.array([fingerprint(split_words(t), size) for t in utf8(column)], dtype=np.uint64).view(np.int64)}

    rows = docs if "__mark" in docs.columns else docs.withColumn("__mark", F.lit(None).cast("long"))
    return map_texts(rows, run, f"id {docs.schema[id_col].dataType.simpleString()}, mark long, fp long", id_col, "__mark", text_col)


# anchors --------------------------------------------------------------------------------------------------------------


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Of the low 31 bits: the exclusive or of the numbers (1 to 31) of the bits that are set. 0 for a code word."""
    s = np.zeros(len(half), dtype=np.uint32)
    for bit in range(31):
        s ^= ((half >> np.uint32(bit)) & np.uint32(1)) * np.uint32(bit + 1)
    return s


def _flip_table() -> list[np.ndarray]:
    """By syndrome: all patterns of at most 2 flipped bits (bit 31 is free) that lead to a code word."""
    by: list[list[int]] = [[] for _ in range(32)]
    one = [(1 << b, b + 1 if b < 31 else 0) for b in range(32)]
    by[0].append(0)
    for k, (m, s) in enumerate(one):
        by[s].append(m)
        for m2, s2 in one[k + 1 :]:
            by[s ^ s2].append(m | m2)
    return [np.array(x, dtype=np.uint32) for x in by]


FLIPS = _flip_table()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors (half in bit 32, code word below) of all copies of the fingerprints."""
    rows, keys = [], []
    for half in (0, 1):
        word = ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        syndrome = _syndrome(word)
        for s in range(32):
            at = np.flatnonzero(syndrome == s)
            rows.append(np.repeat(at, len(FLIPS[s])))
            keys.append((word[at][:, None] ^ FLIPS[s][None]).ravel().astype(np.int64) | (half << 32))
    return np.concatenate(rows), np.concatenate(keys)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        for k in range(0, len(fp), 10_000):
            part = fp[k : k + 10_000]
            rows, keys = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(keys, pa.int64()), "fp": pa.array(part[rows], pa.int64())})


def spanning_links(nodes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the threshold that connect all that such links connect.

    Each fingerprint in turn takes the unvisited ones it reaches, and these go
    next: a dense group costs few comparisons a member, and at most one link
    per member comes out.
    """
    rest = nodes
    a, b = [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            seed = queue.pop()
            near = np.bitwise_count(rest ^ seed) <= threshold
            if near.any():
                reached = rest[near]
                a.append(np.full(len(reached), seed))
                b.append(reached)
                queue.extend(reached)
                rest = rest[~near]
    none = np.empty(0, dtype=nodes.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compare(threshold: int):
    """Over rows sorted by anchor and block pair: links inside each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in whole_groups(batches, ["anchor", "lo", "hi"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            first, size = cut, np.diff(np.r_[cut[cut < len(fp)], len(fp)])
            first = first[: len(size)]
            a, b = [], []
            for n in (2, 3, 4):  # most anchors: all pairs of the few members at once
                at = first[size == n]
                for i in range(n):
                    for j in range(i + 1, n):
                        near = np.bitwise_count(fp[at + i] ^ fp[at + j]) <= threshold
                        a.append(fp[at + i][near])
                        b.append(fp[at + j][near])
            for k, n in zip(first[size > 4], size[size > 4], strict=True):
                x, y = spanning_links(fp[k : k + n], threshold)
                a.append(x)
                b.append(y)
            x, y = forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
            yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def fingerprint_links(distinct: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` that span the near-duplicate graph of distinct fingerprints ``fp``."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the covering is made for thresholds from 0 to {THRESHOLD}")
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small table, but 33 copies of each row
    copies = distinct.select("fp").repartition(tasks).mapInArrow(lean(_spread), "anchor long, fp long")
    return in_blocks(copies, ["anchor"], "fp", block).mapInArrow(lean(_compare(threshold)), "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: int, size: int) -> DataFrame:
    """``(id, mark, fp, component, component_id)``: ``component`` names the group by a fingerprint, ``component_id`` is its least id."""
    each = saved(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = saved(each.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    group = components(fingerprint_links(classes, threshold), contracted=True).select(F.col("node").alias("fp"), "component")
    count = classes.count()  # the tables joined have no more rows
    named = saved(classes.join(bounded(group, count), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = saved(named.join(bounded(least, count), "component").select("fp", "component", "component_id"), "labels")
    return lookup(each, labels, ["fp"], "inner")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """``(id, fp, component_id)`` per row: the group of documents that chains of links connect, named by its least id.

    Rows with equal fingerprints (copies, repeated rows, all texts without
    words) link at once and count as one from then on. Null ids get the group's
    least id, null if it has none. Other columns are ignored.
    """
    found = _grouped(docs.select(id_col, text_col), id_col, text_col, threshold, size)
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The documents without near-duplicates: of each group one row with the least id stays, all columns as they are.

    Rows are judged one by one, by id and content: rows that share an id but
    belong to different groups each count in their own group, and of the rows of
    a group that share its least id the one with the least hash over all columns
    stays. Of rows equal in every column one stays. A row with a null id cannot
    be named and stays.
    """
    cells = (F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema)
    marked = docs.withColumn("__mark", F.xxhash64(*cells))
    rows = _grouped(marked.select("doc_id", "text", "__mark"), "doc_id", "text", threshold, size).where("id is not null")
    found = saved(rows.groupBy("id", "mark", "component", "component_id").agg(F.count("*").alias("n")), "groups")
    best = saved(found.where("id = component_id").groupBy("component").agg(F.min("mark").alias("best")), "best")
    judged = lookup(found, best, ["component"]).select(F.col("id").alias("doc_id"), F.col("mark").alias("__mark"), "n", F.expr("id = component_id and mark = best").alias("stays"))
    choice = saved(judged.where("not stays or n > 1"), "choice")
    keys = ["doc_id", "__mark"]
    out = lookup(marked, choice.where("not stays").select(*keys), keys, "left_anti")
    copies = choice.where("stays").select(*keys)  # of rows that are there more than once
    if not copies.isEmpty():
        out = lookup(out, copies, keys, "left_anti").unionByName(lookup(out, copies, keys, "left_semi").dropDuplicates(keys))
    return out.drop("__mark")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
