"""Octree partitioning.

For point data the tree is a pure function of the counts per cell: a node above
the deepest level is split exactly if it holds more than ``max_items`` rows. So
the fit is one aggregate over cell indices, whatever the order of the rows, and
a label is a table lookup by cell. :class:`Octree` is the insertion-ordered tree
for shapes with an extent; it lives on the driver and is meant for few shapes.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.coords import spherical_to_cartesian
from voxelframe.functions.predicates import box_intersects_box, envelope
from voxelframe.options import SpatialOptions, check_positive
from voxelframe.plans.base import Partitioner
from voxelframe.shapes import Box, Point, Shell

UPPER_MARGIN = 0.001
SHRINK = 0.0001
MAX_LEVEL = 6  # 8**6 cells are the most a fit describes


def octant(lower_z: bool, lower_y: bool, upper_x: bool) -> int:
    return 4 * lower_z + 2 * lower_y + upper_x


def child_box(box: Box, k: int) -> Box:
    mx, my, mz = ((box.min_x + box.max_x) / 2, (box.min_y + box.max_y) / 2, (box.min_z + box.max_z) / 2)
    x = (mx, box.max_x) if k & 1 else (box.min_x, mx)
    y = (box.min_y, my) if k & 2 else (my, box.max_y)
    z = (box.min_z, mz) if k & 4 else (mz, box.max_z)
    return Box(*x, *y, *z)


class Octree:
    """Insertion-ordered octree over shapes: a full node splits when one more arrives."""

    def __init__(self, box: Box, level: int = 0, parent: Octree | None = None, max_items: int = 10, max_level: int = 10):
        self.box, self.level, self.parent = box, level, parent
        self.max_items, self.max_level = max_items, max_level
        self.elements: list[Box] = []
        self.children: list[Octree] = []
        self.partition_id = -1
        self.full = False  # whether more than it can hold has arrived here

    @property
    def is_leaf(self) -> bool:
        return not self.children

    def _split(self) -> None:
        self.children = [Octree(child_box(self.box, k), self.level + 1, self, self.max_items, self.max_level) for k in range(8)]

    def insert(self, shape) -> None:
        box = shape.envelope()
        if self.is_leaf:
            if len(self.elements) < self.max_items or self.level >= self.max_level:
                self.elements.append(box)
                return
            held, self.elements = self.elements, []
            self._split()
            for x in held:
                self.insert(x)
        self.full = True
        target = next((c for c in self.children if c.box.covers(box)), None)
        if target is None:
            self.elements.append(box)  # it straddles a plane and stays here
        else:
            target.insert(box)

    def find(self, shape) -> list[Box]:
        """Elements of every node that meets the shape (candidates: a node's whole list)."""
        box = shape.envelope()
        out = list(self.elements) if self.box.intersects(box) else []
        for c in self.children:
            out += c.find(box)
        return out

    def elements_near(self, shape) -> list[Box]:
        """What shares a branch with the shape: down the nodes that wholly hold its box, their own elements, and all below the last one.

        Only a node that has overflowed is followed further down.
        """
        box, node, out = shape.envelope(), self, []
        while node.full and (below := next((c for c in node.children if c.box.covers(box)), None)) is not None:
            out += node.elements
            node = below
        return out + [x for n in node.nodes() for x in n.elements]

    def nodes(self) -> Iterator[Octree]:
        """Breadth first."""
        queue = deque([self])
        while queue:
            node = queue.popleft()
            yield node
            queue.extend(node.children)

    def leaves(self) -> list[Octree]:
        return [n for n in self.nodes() if n.is_leaf]

    def assign_ids(self) -> None:
        for i, leaf in enumerate(self.leaves()):
            leaf.partition_id = i

    def grow_to(self, level: int) -> None:
        """Split until every branch has this depth."""
        if self.level >= level:
            return
        if self.is_leaf:
            held, self.elements = self.elements, []
            self._split()
            for x in held:
                self.insert(x)
        for c in self.children:
            c.grow_to(level)

    def matched_leaves(self, shape) -> list[Octree]:
        box = shape.envelope()
        return [leaf for leaf in self.leaves() if leaf.box.intersects(box) or leaf.box.covers(box)]

    def leaf_neighbors(self) -> list[Octree]:
        """The leaves under the siblings: those of the parent's cells whose path differs in the last step."""
        beside = [c for c in self.parent.children if c is not self] if self.parent else []
        return [n for c in beside for n in c.depth_first() if n.is_leaf]

    def depth_first(self) -> Iterator[Octree]:
        yield self
        for c in self.children:
            yield from c.depth_first()

    def copy_ids(self) -> list[tuple[int, Box]]:
        return [(leaf.partition_id, leaf.box) for leaf in self.leaves()]


def data_envelope(df: DataFrame, options: SpatialOptions, margin: float = UPPER_MARGIN) -> Box:
    """Min/max box over all row envelopes, its upper sides moved out by ``margin``: one aggregate, one row."""
    b = envelope(_row_shape(options))
    low, high = (b.min_x, b.min_y, b.min_z), (b.max_x, b.max_y, b.max_z)
    row = df.agg(*(F.min(c).alias(f"l{k}") for k, c in enumerate(low)), *(F.max(c).alias(f"h{k}") for k, c in enumerate(high))).first()
    if any(v is None for v in row):
        return Box.null()
    return Box(*(v for k in range(3) for v in (row[f"l{k}"], row[f"h{k}"]))).expanded_outwards(margin)


def _row_shape(options: SpatialOptions):
    center = Point(*(F.col(f"`{c}`") for c in options.center), spherical=options.spherical)
    return center if options.geometry == "points" else Shell(center, 0.0, F.col(f"`{options.colnames[3]}`"))


def _cuts(lo: float, hi: float, level: int) -> list[float]:
    """Inner borders of one axis after ``level`` halvings, by repeated midpoints."""
    if level == 0:
        return []
    mid = (lo + hi) / 2
    return [*_cuts(lo, mid, level - 1), mid, *_cuts(mid, hi, level - 1)]


class OctreePartitioner(Partitioner):
    def __init__(self, tree: Octree, options: SpatialOptions, depth: int):
        self.tree, self.options, self.depth = tree, options, depth
        tree.assign_ids()
        self._leaves = tree.leaves()

    @classmethod
    def fit(cls, df: DataFrame, options: SpatialOptions, num_partitions: int, sample_fraction: float | None = None) -> OctreePartitioner:
        """Cut the data's box so that no cell holds much more than its share; at most ``num_partitions`` cells.

        Two aggregates: the envelope, then rows per cell of the deepest level
        (at most ``num_partitions`` rows come back). ``sample_fraction`` counts
        on a sample instead, scaled up.
        """
        check_positive(num_partitions)
        depth = int(math.log(num_partitions) / math.log(8) + 1e-9)
        if depth > MAX_LEVEL:
            raise AssertionError(f"an octree describes fewer than {8 ** (MAX_LEVEL + 1)} partitions (asked for {num_partitions})")
        box = data_envelope(df, options)
        root = Octree(box, max_level=depth)
        out = cls(root, options, depth)
        if box.is_null() or depth == 0:
            return out
        source = df if sample_fraction is None else df.sample(sample_fraction, seed=1)
        counts = {r["code"]: r["n"] for r in source.select(out._code(*(F.col(f"`{c}`") for c in options.center)).alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        max_items = math.ceil(total / 8 ** (depth + 1))
        by_level = [dict(counts)]
        for _ in range(depth):
            up: dict[int, int] = {}
            for code, n in by_level[0].items():
                up[code >> 3] = up.get(code >> 3, 0) + n
            by_level.insert(0, up)
        todo = [(root, 0)]
        while todo:
            node, code = todo.pop()
            if node.level < depth and by_level[node.level].get(code, 0) > max_items:
                node._split()
                todo += [(c, (code << 3) | k) for k, c in enumerate(node.children)]
        return cls(root, options, depth)

    @property
    def numPartitions(self) -> int:
        return len(self._leaves)

    def _xyz(self, x, y, z) -> tuple[Column, Column, Column]:
        return spherical_to_cartesian(x, y, z) if self.options.spherical else (x.cast("double"), y.cast("double"), z.cast("double"))

    def _step(self, c: Column, axis: int) -> Column:
        """Number of a coordinate's cell along an axis at the deepest level."""
        lo, hi = self.tree.box.bounds[2 * axis : 2 * axis + 2]
        return sum(((c >= cut).cast("int") for cut in _cuts(lo, hi, self.depth)), F.lit(0))

    def _path(self, steps: Sequence[Column]) -> Column:
        """Path of a cell at the deepest level, three bits per level, from its numbers along the axes."""
        code = F.lit(0)
        for level in range(self.depth):
            bit = [F.shiftright(s, self.depth - 1 - level).bitwiseAND(1) for s in steps]
            code = code * 8 + (1 - bit[2]) * 4 + (1 - bit[1]) * 2 + bit[0]
        return code

    def _code(self, x, y, z) -> Column:
        """Path of the row's cell; null if a coordinate is null."""
        xyz = self._xyz(x, y, z)
        return F.when(xyz[0].isNotNull() & xyz[1].isNotNull() & xyz[2].isNotNull(), self._path([self._step(c, k) for k, c in enumerate(xyz)]))

    def _ids_by_code(self) -> list[int]:
        ids = [0] * 8**self.depth
        todo = [(self.tree, 0)]
        while todo:
            node, code = todo.pop()
            if node.is_leaf:
                span = 8 ** (self.depth - node.level)
                ids[code * span : (code + 1) * span] = [node.partition_id] * span
            todo += [(c, code * 8 + k) for k, c in enumerate(node.children)]
        return ids

    def label(self, x, y, z) -> Column:
        """Rows beyond the root box (which a fit on the same data never has) go to the nearest border cell."""
        if self.depth == 0:
            return F.when(x.isNotNull() & y.isNotNull() & z.isNotNull(), F.lit(0)).cast("int")
        return F.get(F.lit(self._ids_by_code()), self._code(x, y, z)).cast("int")

    def home(self, point: Sequence[float]) -> int:
        x, y, z = Point(*point, spherical=self.options.spherical).cartesian().xyz
        node = self.tree
        while not node.is_leaf:
            b = node.box
            k = octant(z < (b.min_z + b.max_z) / 2, y < (b.min_y + b.max_y) / 2, x >= (b.min_x + b.max_x) / 2)
            node = node.children[k]
        return node.partition_id

    def cells(self) -> list[tuple[int, Box]]:
        return [(leaf.partition_id, leaf.box) for leaf in self._leaves]

    def cells_within(self, point: Sequence[float], r: float) -> list[int]:
        """By distance to the cell; border cells also stand for what lies beyond them."""
        p, root, ids = Point(*point, spherical=self.options.spherical).cartesian().xyz, self.tree.box.bounds, []
        reach = r + 1e-9 * (max(map(abs, p)) + r + 1.0)
        for leaf in self._leaves:
            b, gap = leaf.box.bounds, 0.0
            for k, c in enumerate(p):
                lo = -math.inf if b[2 * k] == root[2 * k] else b[2 * k]
                hi = math.inf if b[2 * k + 1] == root[2 * k + 1] else b[2 * k + 1]
                gap += max(lo - c, c - hi, 0.0) ** 2
            if math.sqrt(gap) <= reach:
                ids.append(leaf.partition_id)
        return ids

    def leaf_table(self, spark) -> DataFrame:
        """The grid as a table, at most ``num_partitions`` rows."""
        rows = [(leaf.partition_id, leaf.level, *map(float, leaf.box.bounds)) for leaf in self._leaves]
        return spark.createDataFrame(rows, "partition_id int, level int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")

    def place_objects(self, df: DataFrame, shape) -> DataFrame:
        """Each row once for every cell its envelope meets, as ``partition_id``; rows that meet none (or have no envelope) go.

        Narrow, without a join: the envelope spans a range of cells along each
        axis, and the leaves of these cells are looked up in a table of fixed size.
        """
        e, root = envelope(shape), self.tree.box
        low, high = (e.min_x, e.min_y, e.min_z), (e.max_x, e.max_y, e.max_z)
        meets = box_intersects_box(root, e)
        spans = df.where(meets).withColumns({f"__{n}{k}": self._step(c, k) for n, side in (("lo", low), ("hi", high)) for k, c in enumerate(side)})
        span = lambda k: F.sequence(F.col(f"__lo{k}"), F.col(f"__hi{k}"))
        if self.depth == 0:
            ids = F.array(F.lit(self._leaves[0].partition_id))
        else:
            leaf = F.lit(self._ids_by_code())
            ids = F.flatten(F.flatten(F.transform(span(0), lambda i: F.transform(span(1), lambda j: F.transform(span(2), lambda k: F.get(leaf, self._path([i, j, k])))))))
        extra = [f"__{n}{k}" for n in ("lo", "hi") for k in range(3)]
        return spans.withColumn("partition_id", F.explode(F.array_distinct(ids.cast("array<int>")))).drop(*extra)

    def partition_nodes(self, shape) -> list[tuple[int, Box]]:
        return [(leaf.partition_id, leaf.box) for leaf in self.tree.matched_leaves(shape)]

    def place_object(self, shape) -> list[int]:
        return [i for i, _ in self.partition_nodes(shape)]

    def neighbor_nodes(self, shape, inclusive: bool = False) -> list[tuple[int, Box]]:
        out = [(n.partition_id, n.box) for leaf in self.tree.matched_leaves(shape) for n in leaf.leaf_neighbors()]
        return out + (self.partition_nodes(shape) if inclusive else [])

    def secondary_neighbor_nodes(self, cell, cell_id: int) -> list[tuple[int, Box]]:
        return self.neighbor_nodes(cell.envelope().expanded(-SHRINK))


def build_tree(shapes: Iterable, box: Box, max_items: int, max_level: int = 10) -> Octree:
    """An insertion-ordered tree over a few shapes, its leaves numbered."""
    tree = Octree(box, max_items=max_items, max_level=max_level)
    for s in shapes:
        tree.insert(s)
    tree.assign_ids()
    return tree
