import math

import numpy as np
import pytest

from voxelframe.plans.octree import Octree, OctreePartitioner, build_tree
from voxelframe.plans.onion import OnionPartitioner
from voxelframe.options import SpatialOptions
from voxelframe.shapes import Box, Point, Shell

BOX = Box.of_points(Point(-2.0, 11.0, 0.5), Point(4.5, 8.0, 2.25), Point(1.0, 9.5, -3.75))


def boxes(seed: int, n: int, side: float = 8.0, largest: float = 3.0) -> list[Box]:
    rng = np.random.default_rng(seed)
    low = rng.random((n, 3)) * (side - largest)
    return [Box(*np.c_[a, a + s].ravel().tolist()) for a, s in zip(low, rng.random((n, 3)) * largest, strict=True)]


def test_points():
    a, b = Point(0.0, 0.0, 0.0), Point(1.0, 1.0, 1.0)
    assert a.distance(b) == math.dist(a.xyz, b.xyz)
    assert a.volume() == 0.0 and a.center is a and not a.equals(b)
    assert Point(1.0, 0.0, 0.0, True).distance(Point(0.0, 0.0, 0.0, True)) == 1.0
    assert Point(1.0, 1.0, 1.0, True).distance(Point(1.0, 1.0, 1.0, True)) == 0.0  # never NaN
    assert a.close_to(b, math.sqrt(3)) and not a.close_to(b, 1.7)
    assert a.equals(Point(0.0, 0.0, 0.0, True))
    with pytest.raises(AssertionError):
        a.distance(Point(0.0, 0.0, 0.0, True))


def test_shells():
    s = Shell.of(1.0, -2.0, 0.5, False, 3.0, 7.0)
    at = lambda d: Point(1.0 + d, -2.0, 0.5)
    assert s.area() == pytest.approx(4 * math.pi * (7.0**2 - 3.0**2))
    for d in np.arange(0.0, 9.0, 0.5).tolist():
        assert s.contains_point(at(d)) == (3.0 <= d < 7.0)
        grown = s.including(at(d))
        assert grown.contains_point(at(d)) and (grown == s) == (3.0 <= d < 7.0) and (grown.r_in, grown.r_out) == (min(d, 3.0), 7.0 if d < 7.0 else d + 0.1)
    assert Shell.null().is_null() and Shell.null().area() == 0.0 and s.to_null().is_null()
    for r_in, r_out in ((1.0, 2.0), (1.0, 9.0), (4.0, 9.0), (4.0, 5.0)):
        assert s.including(Shell(s.center, r_in, r_out)) == Shell(s.center, min(r_in, 3.0), 7.0 if r_out < 7.0 else r_out + 0.1)
    assert s.expanded(2) == Shell(s.center, 5.0, 9.0) and s.inner_expanded(4.5).is_null() and s.inner_expanded(0.5).r_in == 3.5 and s.outer_expanded(2).r_out == 9.0
    for d in np.arange(0.0, 14.0, 0.5).tolist():
        ball = Shell(at(d), 0.0, 1.5)
        assert s.contains(ball) == (d + 1.5 <= 3.0) and s.intersects(ball) == (d + 1.5 >= 3.0 and d <= 8.5)
    assert s.intersects(Box(7.5, 9.0, -2.0, -1.0, 0.0, 1.0)) and s.envelope() == Box(-6.0, 8.0, -9.0, 5.0, -6.5, 7.5)
    assert s.equals(Shell.of(1.0, -2.0, 0.5, False, 3.0, 7.0)) and not s.equals(Shell.null())
    with pytest.raises(AssertionError):
        s.including(Shell.of(2.0, 0.0, 0.0, False, 1.0, 2.0))
    with pytest.raises(AssertionError):
        s.intersects("x")


def test_boxes():
    assert BOX == Box(-2.0, 4.5, 8.0, 11.0, -3.75, 2.25)
    assert BOX.min_extent() == 3.0 and BOX.max_extent() == 6.5 and BOX.volume() == 6.5 * 3.0 * 6.0
    assert Box.null().is_null() and Box.null().volume() == 0.0 and Box.null().lengths() == (0.0, 0.0, 0.0)
    assert BOX.expanded_outwards(1).min_x == -2.0 and BOX.expanded_outwards(1).max_x == 5.5 and BOX.expanded(1, 2, 3).min_z == -6.75
    assert BOX.including(Point(10.0, 9.0, 0.0)).max_x == 10.0 and Box.null().including(BOX) == BOX
    assert BOX.translated(1, 0, 0).center.x == 2.25  # the centre moves too
    unit, far = Box(0.0, 1.0, 0.0, 1.0, 0.0, 1.0), Box(3.0, 4.0, 1.0, 2.0, 7.0, 8.0)
    assert unit.intersection(far) == Box(0.0, 4.0, 0.0, 2.0, 0.0, 8.0) and unit.overlap(far).is_null() and unit.intersection(Box.null()) is None
    assert unit.distance(far) == pytest.approx(math.sqrt(2.0**2 + 0.0 + 6.0**2)) and unit.distance(unit) == 0.0
    assert not unit.covers(unit) and Box(-1.0, 2.0, -1.0, 2.0, -1.0, 2.0).covers(unit)
    assert unit.contains_point(Point(0.0, 0.0, 0.0)) and not unit.contains_point(Point(1.0, 0.0, 0.0))
    assert not unit.intersects(Box(1.0, 2.0, 0.0, 1.0, 0.0, 1.0)) and unit.intersects(Box(-1.0, 0.0, 0.0, 1.0, 0.0, 1.0))
    assert unit.intersects_region(Point(0.5, 0.5, 0.5), Point(2.0, 2.0, 2.0), Point(2.0, 0.0, 0.0)) and not Box.null().intersects_region(*[Point(0.0, 0.0, 0.0)] * 3)
    assert Box.null().equals(Box(1.0, 0.0, 0.0, 0.0, 0.0, 0.0)) and Box.of(2, 1, 4, 3, 6, 5) == Box(1, 2, 3, 4, 5, 6)
    assert str(unit) == "Env[0.0 : 1.0, 0.0 : 1.0, 0.0 : 1.0, ]"
    with pytest.raises(AssertionError):
        Box.of_points(Point(0.0, 0.0, 0.0, True))
    with pytest.raises(AssertionError):
        unit.contains_point(Point(0.0, 0.0, 0.0, True))


def test_octree_of_boxes():
    """Against plain loops over its own nodes and elements."""
    root = Box(0.0, 8.0, 0.0, 8.0, 0.0, 8.0)
    shapes = boxes(1, 60)
    tree = Octree(root, max_items=4)
    for k, b in enumerate(shapes):
        tree.insert(b)
        assert sum(len(n.elements) for n in tree.nodes()) == k + 1 and (tree.is_leaf or k >= 4)
    assert len(list(tree.nodes())) == len(list(tree.depth_first())) > 9
    for n in tree.nodes():
        assert all(n is tree or n.box.covers(x) for x in n.elements) and (n.is_leaf or not any(c.box.covers(x) for c in n.children for x in n.elements))
    leaves = tree.leaves()
    assert sum(n.box.volume() for n in leaves) == pytest.approx(root.volume())
    for q in [*boxes(2, 30), Shell.of(4.0, 4.0, 4.0, False, 0.0, 1.0)]:
        found = tree.find(q)
        assert all(x in found for x in shapes if x.intersects(q.envelope()) and q.envelope().intersects(x))
    grid = OctreePartitioner(tree, SpatialOptions(), 0)
    assert grid.numPartitions == len(leaves) == hash(grid) and [i for i, _ in grid.cells()] == list(range(len(leaves)))
    for q in boxes(3, 30):
        assert sorted(grid.place_object(q)) == sorted(n.partition_id for n in leaves if n.box.intersects(q))
    for n in leaves:
        beside = [m for m in leaves if m is not n and n.parent.box.covers(Box(*(v for a, b in zip(m.box.bounds[::2], m.box.bounds[1::2]) for v in ((a + b) / 2,) * 2)))]
        assert {m.partition_id for m in n.leaf_neighbors()} == {m.partition_id for m in beside}
    wide = build_tree([Shell.of(4.0, 4.0, 4.0, False, 0.0, 3.0)], root, 2)
    assert wide.is_leaf and wide.leaf_neighbors() == []
    wide.grow_to(2)
    assert len(wide.leaves()) == 8**2 and sum(len(n.elements) for n in wide.nodes()) == 1


def test_onion_cells():
    g = OnionPartitioner(10, 1.0)
    assert g.home((0.0, 0.0, 0.45)) == 4 and g.home((0.0, 0.0, 10.0)) == 9
    p = Point(0.0, 0.0, 0.55)
    assert len(g.neighbor_nodes(p)) == 2 and len(g.neighbor_nodes(p, inclusive=True)) == 3
    assert [i for i, _ in g.neighbor_nodes(Point(0.0, 0.0, 0.0))] == [1] and OnionPartitioner(1, 1.0).neighbor_nodes(p) == []
    assert g.cells()[9][1].r_out == pytest.approx(1.1) and g.place_object(p) == [5] and g.cells_within((0.0, 0.0, 0.5), 0.12) == [3, 4, 5, 6]
