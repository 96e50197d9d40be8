"""Embedding near-duplicates (operator 8): lattice hashing with verified cosines.

Each table projects unit vectors at random into blocks of eight dimensions and
decodes every block to its nearest point of the E8 lattice; the points of the
blocks together are the vector's home cell. A vector also visits neighbouring
cells, the ones it is nearest to beyond its own. Vectors that meet in a cell are
compared exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from voxelframe.llm.common import bounded, in_blocks, lean, lookup, prepare_workers, saved, whole_groups
from voxelframe.llm.components import components, forest

THRESHOLD = 0.9
SEED = 8
BLOCK = 2048  # vectors of one cell that are compared as one unit
ROWS, PAIRS = 256, 200_000  # rows compared at a time; pairs held at a time


@dataclass(frozen=True)
class Plan:
    """How vectors are hashed: tables, blocks of eight dimensions in a cell, neighbouring cells visited, scale of the lattice for unit vectors."""

    tables: int
    blocks: int
    probes: int
    scale: float


#: By the number of distinct vectors (a power of two that it stays below). Unrelated vectors share a cell of a table with
#: a chance of 5e-5, 7e-6 and 2e-7, so finer cells keep the vectors that each one is compared with to some thousands;
#: pairs at the threshold meet with a chance of 0.95 to 0.97 in all of them.
PLANS = ((22, Plan(8, 2, 4, 1.7)), (26, Plan(9, 3, 12, 1.9)), (64, Plan(17, 4, 16, 2.0)))


def plan_for(vectors: int) -> Plan:
    return next(p for bits, p in PLANS if vectors < 1 << bits)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            whole.append(v)
    half = [[s / 2 for s in signs] for signs in product((1, -1), repeat=8) if signs.count(-1) % 2 == 0]
    return np.array(whole + half)


ROOTS = roots()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: if the sum is odd, the worst-rounded coordinate goes the other way."""
    f = np.rint(y)
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    if len(odd):
        gap = y[odd] - f[odd]
        k = np.abs(gap).argmax(axis=1)
        rows = np.arange(len(odd))
        f[odd, k] += np.where(gap[rows, k] >= 0, 1.0, -1.0)
    return f


def decode_e8(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8, which is D8 and D8 shifted by one half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


class LatticeHash:
    def __init__(self, dims: int, plan: Plan, seed: int):
        rng = np.random.default_rng(seed)
        self.tables, self.blocks, self.probes = plan.tables, plan.blocks, plan.probes
        self.project = rng.standard_normal((self.tables, self.blocks, dims, 8)) / plan.scale
        self.mix = rng.integers(1, 2**62, (self.tables, self.blocks, 8), dtype=np.int64) | 1

    def _key(self, points: np.ndarray, table: int, block: int) -> np.ndarray:
        return (np.rint(points * 2).astype(np.int64) * self.mix[table, block]).sum(axis=-1)

    def cells(self, v: np.ndarray) -> np.ndarray:
        """Cell ids, shape (vectors, tables, 1 + probes); the home cell comes first."""
        out = np.empty((len(v), self.tables, 1 + self.probes), dtype=np.int64)
        for t in range(self.tables):
            own, ways, gains = [], [], []
            for b in range(self.blocks):
                y = v @ self.project[t, b]
                p = decode_e8(y)
                gain = (y - p) @ ROOTS.T  # the larger, the nearer the neighbour in this direction
                k = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes]
                own.append(self._key(p, t, b))
                ways.append(np.stack([self._key(p + ROOTS[k[:, i]], t, b) for i in range(self.probes)], axis=1) - own[b][:, None])
                gains.append(np.take_along_axis(gain, k, axis=1))
            home = np.sum(own, axis=0)
            order = np.argsort(-np.concatenate(gains, axis=1), axis=1)[:, : self.probes]
            out[:, t, 0] = home
            out[:, t, 1:] = home[:, None] + np.take_along_axis(np.concatenate(ways, axis=1), order, axis=1)
        return out


@lru_cache(maxsize=8)
def lattice_hash(dims: int, plan: Plan, seed: int) -> LatticeHash:
    return LatticeHash(dims, plan, seed)


def _unit(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can link, and their vectors scaled to length one."""
    size = column.value_lengths().fill_null(0).to_numpy()
    at = np.flatnonzero(size == dims)
    if not dims or not len(at):
        return at[:0], np.empty((0, max(dims, 1)))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(all="ignore"):
        largest = np.abs(flat).max(axis=1)
        scaled = flat / largest[:, None]  # keeps squares of very small or large components in range
        v = scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]
    good = np.isfinite(largest) & (largest > 0) & np.isfinite(v).all(axis=1)
    return at[good], v[good]


def _unseen(keys: np.ndarray, tab: np.ndarray, cell: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs ``(i, j)``, which share ``cell`` of table ``tab``, share no cell before it: a pair counts where it first meets."""
    fresh = np.ones(len(i), dtype=bool)
    for s in range(keys.shape[1]):
        upto = np.flatnonzero(fresh & (tab >= s))
        if not len(upto):
            continue
        x, y = keys[i[upto], s], keys[j[upto], s]
        same = (x[:, :, None] == y[:, None, :]) & ((tab[upto] > s)[:, None, None] | (x < cell[upto, None])[:, :, None])
        fresh[upto[same.any(axis=(1, 2))]] = False
    return fresh


def _met_before(keys: np.ndarray, tab: int, cell: int) -> bool:
    """Whether all vectors of a unit share a home cell that comes before the unit's own, so that each pair has met there."""
    homes = keys[:, :, 0]
    same = (homes[:, : tab + 1] == homes[0, : tab + 1]).all(axis=0)
    return bool(same[:tab].any() or (same[tab] and homes[0, tab] < cell))


def _pairs(v: np.ndarray, threshold: float, cut: np.ndarray, own: np.ndarray, whole: np.ndarray, keys: np.ndarray, tab: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows inside each unit, ``cut`` telling where units begin, without those that share the first table's home elsewhere; in pieces of bounded size."""
    first, size = cut[:-1], np.diff(cut)
    two = first[size == 2]
    if len(two):
        good = ((v[two] * v[two + 1]).sum(axis=1) >= threshold) & (whole[two] | (own[two] != own[two + 1]))
        yield two[good], two[good] + 1
    some_i, some_j, n = [], [], 0
    for k, m in zip(first[size > 2], size[size > 2], strict=True):
        if _met_before(keys[k : k + m], tab[k], cell[k]):
            continue
        home = keys[k : k + m, 0, 0]
        for lo in range(k, k + m, ROWS):
            near = v[lo : min(lo + ROWS, k + m)] @ v[k : k + m].T >= threshold
            if tab[k]:
                near &= home[lo - k : lo - k + len(near), None] != home[None]
            i, j = np.nonzero(near)
            i, j = i + lo, j + k
            good = (i < j) & (whole[k] | (own[i] != own[j]))
            some_i.append(i[good])
            some_j.append(j[good])
            n += len(some_i[-1])
            if n > PAIRS:
                yield np.concatenate(some_i), np.concatenate(some_j)
                some_i, some_j, n = [], [], 0
    if n:
        yield np.concatenate(some_i), np.concatenate(some_j)


def _verify(threshold: float, plan: Plan):
    """Over sorted units: the weight of what each node links to where it first meets it, and links that span them."""

    def by_length(tables: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        for t, cut in tables:
            cut = cut[cut < t.num_rows]
            dims = t.column("dims").to_numpy()
            ends = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1), t.num_rows]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                yield t.slice(lo, hi - lo), cut[(cut >= lo) & (cut < hi)] - lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in by_length(whole_groups(batches, ["dims", "cell", "tab", "lo", "hi"])):
            dims = t.column("dims")[0].as_py()
            node, weight, tab, cell, own, lo, hi = (t.column(c).to_numpy() for c in ("node", "weight", "tab", "cell", "own", "lo", "hi"))
            at, v = _unit(t.column("embedding").combine_chunks(), dims)
            assert len(at) == len(node), "only vectors that can link have cells"
            keys = t.column("cells").combine_chunks().flatten().to_numpy().reshape(len(node), plan.tables, 1 + plan.probes)
            for i, j in _pairs(v, threshold, np.r_[cut[cut < len(node)], len(node)], own, lo == hi, keys, tab, cell):
                if not len(i):
                    continue
                new = _unseen(keys, tab[i], cell[i], i, j)
                i, j = i[new], j[new]
                sums = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
                n = np.flatnonzero(sums)
                a, b = forest(node[i], node[j])
                other = pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(b, pa.int64())])
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.r_[node[n], a]), "links": pa.array(np.r_[sums[n].astype(np.int64), np.zeros(len(a), np.int64)]), "other": other})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, plan: Plan | None = None, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    ``n_links`` counts the other rows with a cosine of at least ``threshold``
    that share a cell with it in some table; ``component_id`` is the least id
    that chains of links reach. Equal vectors (copies, repeated rows) always
    link and are hashed once. Vectors that are null, zero, hold a null or
    non-finite component link with nothing; rows with a null id neither. Each
    length is hashed on its own, so only vectors of equal length link. Ids must
    be integers. Without a ``plan`` the number of distinct vectors chooses it.
    """
    prepare_workers(vectors.sparkSession)
    kind = vectors.schema[vector_col].dataType
    kind = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"  # cosines are worked out in double precision
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("embedding"))
    usable = F.col("id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where(usable)
    # one node per distinct vector, named by its least id
    one, two = F.xxhash64("embedding"), F.xxhash64("embedding", F.lit(1))
    distinct = saved(good.groupBy("embedding").agg(F.min("id").alias("node"), F.count("*").cast("long").alias("weight")), "vectors")
    size = distinct.count()
    plan = plan_for(size) if plan is None else plan
    each = plan.tables * (1 + plan.probes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                for dims in np.unique(part.column("embedding").value_lengths().to_numpy()).tolist():
                    at, v = _unit(part.column("embedding"), dims)
                    some = part.take(pa.array(at))
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * each), pa.array(lattice_hash(dims, plan, seed).cells(v).ravel()))
                    yield pa.RecordBatch.from_arrays([*some.columns, cells, pa.array(np.full(len(at), dims, dtype=np.int32))], names=["embedding", "node", "weight", "cells", "dims"])

    classes = saved(distinct.select("embedding", "node", "weight").mapInArrow(lean(hashed), f"embedding {kind}, node long, weight long, cells array<long>, dims int"), "cells")
    members = classes.select("node", "dims", F.posexplode("cells").alias("at", "cell")).select("dims", "cell", F.expr(f"cast(at div {1 + plan.probes} as int)").alias("tab"), "node")
    units = in_blocks(members, ["dims", "cell", "tab"], "node", block, attach=classes.drop("dims"))
    found = saved(units.select("dims", "cell", "tab", "node", "own", "lo", "hi", "weight", "embedding", "cells").mapInArrow(lean(_verify(threshold, plan)), "node long, links long, other long"), "found")
    group = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "n")
    degree = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "weight", one.alias("k1"), two.alias("k2")).join(bounded(degree, size), "node", "left").join(bounded(group, size), F.col("n") == F.col("node"), "left")
    labels = saved(named.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "node").alias("component")), "labels")
    keyed = rows.select("id", F.when(usable, one).alias("k1"), F.when(usable, two).alias("k2"))
    return lookup(keyed, labels, ["k1", "k2"]).select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
