"""Predicates and measures between points, shells and boxes as Columns.

Each argument is a shape of :mod:`voxelframe.shapes` (a constant) or one whose
fields are Columns or column names (a shape per row); see :func:`shape_of`.
Upper bounds are half-open throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelframe.functions.coords import col, distance, spherical_to_cartesian
from voxelframe.shapes import MARGIN, Box, Point, Shell


def shape_of(kind: str, *fields, spherical: bool = False):
    """A per-row shape: ``point`` (x, y, z), ``sphere`` (x, y, z, r), ``shell`` (x, y, z, r_in, r_out) or ``box`` (min/max by axis)."""
    if kind == "point":
        return Point(*fields, spherical=spherical)
    if kind == "sphere":
        return Shell(Point(*fields[:3], spherical=spherical), 0.0, fields[3])
    if kind == "shell":
        return Shell(Point(*fields[:3], spherical=spherical), *fields[3:])
    if kind == "box":
        return Box(*fields)
    raise AssertionError(f"Cannot build a shape of kind {kind!r}")


def _same_system(a: Point, b: Point) -> None:
    if a.spherical != b.spherical:
        raise AssertionError("Points must have the same coordinate system!")


def point_distance(a: Point, b: Point) -> Column:
    _same_system(a, b)
    return distance(a.xyz, b.xyz, a.spherical)


def point_equals(a: Point, b: Point) -> Column:
    """Exact equality of the three coordinates, whatever the coordinate systems."""
    (ax, ay, az), (bx, by, bz) = map(_cols, (a.xyz, b.xyz))
    return (ax == bx) & (ay == by) & (az == bz)


def _cols(values) -> list[Column]:
    return [col(v) for v in values]


def center_close_to(a: Point, b: Point, eps: float) -> Column:
    return point_distance(a, b) <= col(eps)


def shell_is_null(s: Shell) -> Column:
    lo, hi = col(s.r_in), col(s.r_out)
    return (lo < 0) | (hi < 0) | (lo > hi)


def point_in_shell(p: Point, s: Shell) -> Column:
    d = point_distance(p, s.center)
    return ~shell_is_null(s) & (d >= col(s.r_in)) & (d < col(s.r_out))


def box_is_null(b: Box) -> Column:
    x0, x1, y0, y1, z0, z1 = _cols(b.bounds)
    return (x0 > x1) | (y0 > y1) | (z0 > z1)


def point_in_box(p: Point, b: Box) -> Column:
    """``min <= c < max`` on each axis. Against constants this is a conjunction of ranges, which reaches the scan."""
    if p.spherical:
        raise AssertionError("Input Box coordinates must have cartesian coordinate!")
    (x, y, z), (x0, x1, y0, y1, z0, z1) = _cols(p.xyz), _cols(b.bounds)
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1) & (z >= z0) & (z < z1)


def box_covers_box(outer: Box, inner: Box) -> Column:
    o, i = _cols(outer.bounds), _cols(inner.bounds)
    inside = (i[0] >= o[0]) & (i[1] < o[1]) & (i[2] >= o[2]) & (i[3] < o[3]) & (i[4] >= o[4]) & (i[5] < o[5])
    return ~box_is_null(outer) & ~box_is_null(inner) & inside


def box_intersects_box(a: Box, b: Box) -> Column:
    """Overlap; only the second box is checked for null."""
    p, q = _cols(a.bounds), _cols(b.bounds)
    apart = F.lit(False)
    for k in (0, 2, 4):
        apart = apart | (q[k] >= p[k + 1]) | (q[k + 1] < p[k])
    return ~box_is_null(b) & ~apart


def box_intersects_region(b: Box, p1: Point, p2: Point, p3: Point) -> Column:
    return ~box_is_null(b) & box_intersects_box(b, box_of_points(p1, p2, p3))


def shell_intersects_shell(a: Shell, b: Shell) -> Column:
    d = point_distance(a.center, b.center)
    in1, out1, in2, out2 = _cols((a.r_in, a.r_out, b.r_in, b.r_out))
    return ~shell_is_null(a) & ~shell_is_null(b) & ~((d + out2 < in1) | (d + out1 < in2)) & (d <= out1 + out2)


def shell_contains_shell(a: Shell, b: Shell) -> Column:
    """True if the second lies wholly in the hole of the first."""
    return ~shell_is_null(a) & ~shell_is_null(b) & (point_distance(a.center, b.center) + col(b.r_out) <= col(a.r_in))


def box_of_points(*points: Point) -> Box:
    if any(p.spherical for p in points):
        raise AssertionError("Input Box coordinates must have cartesian coordinate!")
    axes = list(zip(*(_cols(p.xyz) for p in points), strict=True))
    low = [F.least(*a) if len(a) > 1 else a[0] for a in axes]
    high = [F.greatest(*a) if len(a) > 1 else a[0] for a in axes]
    return Box(low[0], high[0], low[1], high[1], low[2], high[2])


def envelope(shape) -> Box:
    """Cartesian bounding box of a shape, as Columns."""
    if isinstance(shape, Box):
        return Box(*_cols(shape.bounds))
    point, r = (shape.center, col(shape.r_out)) if isinstance(shape, Shell) else (shape, F.lit(0.0))
    x, y, z = spherical_to_cartesian(*point.xyz) if point.spherical else _cols(point.xyz)
    return Box(x - r, x + r, y - r, y + r, z - r, z + r) if isinstance(shape, Shell) else Box(x, x, y, y, z, z)


def shell_intersects_box(s: Shell, b: Box, exact: bool = False) -> Column:
    """By the shell's bounding box; ``exact`` asks for the sphere's distance to the box instead."""
    if not exact:
        return ~shell_is_null(s) & box_intersects_box(b, envelope(s))
    x, y, z = spherical_to_cartesian(*s.center.xyz) if s.center.spherical else _cols(s.center.xyz)
    near, far = F.lit(0.0), F.lit(0.0)
    for c, lo, hi in ((x, b.min_x, b.max_x), (y, b.min_y, b.max_y), (z, b.min_z, b.max_z)):
        lo, hi = col(lo), col(hi)
        gap = F.greatest(lo - c, c - hi, F.lit(0.0))
        reach = F.greatest(F.abs(c - lo), F.abs(c - hi))
        near, far = near + gap * gap, far + reach * reach
    return ~shell_is_null(s) & ~box_is_null(b) & (F.sqrt(near) < col(s.r_out)) & (F.sqrt(far) >= col(s.r_in))


def box_distance(a: Box, b: Box) -> Column:
    """0 where they intersect, else the Euclidean gap."""
    p, q = _cols(a.bounds), _cols(b.bounds)
    total = F.lit(0.0)
    for k in (0, 2, 4):
        gap = F.greatest(q[k] - p[k + 1], p[k] - q[k + 1], F.lit(0.0))
        total = total + gap * gap
    return F.when(box_intersects_box(a, b), 0.0).otherwise(F.sqrt(total))


def intersects(row, window) -> Column:
    """Dispatch on the kinds of both shapes."""
    kinds = (type(row), type(window))
    if kinds == (Point, Point):
        return point_equals(row, window)
    if kinds == (Point, Shell):
        return point_in_shell(row, window)
    if kinds == (Shell, Point):
        return point_in_shell(window, row)
    if kinds == (Point, Box):
        return point_in_box(row, window)
    if kinds == (Box, Point):
        return point_in_box(window, row)
    if kinds == (Shell, Shell):
        return shell_intersects_shell(row, window)
    if kinds == (Shell, Box):
        return shell_intersects_box(row, window)
    if kinds == (Box, Shell):
        return shell_intersects_box(window, row)
    if kinds == (Box, Box):
        return box_intersects_box(row, window)
    raise AssertionError(f"Cannot perform intersection between {kinds[0].__name__} and {kinds[1].__name__}")


# measures -------------------------------------------------------------------------------------------------------------


def shell_area(s: Shell) -> Column:
    lo, hi = col(s.r_in), col(s.r_out)
    return F.when(shell_is_null(s), 0.0).otherwise(F.lit(4.0) * F.pi() * (hi * hi - lo * lo))


def box_lengths(b: Box) -> tuple[Column, Column, Column]:
    c, null = _cols(b.bounds), box_is_null(b)
    x, y, z = (F.when(null, 0.0).otherwise(c[k + 1] - c[k]) for k in (0, 2, 4))
    return x, y, z


def box_volume(b: Box) -> Column:
    x, y, z = box_lengths(b)
    return x * y * z


def box_hull(a: Box, b: Box) -> Box:
    """Smallest box around both."""
    p, q = _cols(a.bounds), _cols(b.bounds)
    return Box(*(F.least(p[k], q[k]) if k % 2 == 0 else F.greatest(p[k], q[k]) for k in range(6)))


def box_overlap(a: Box, b: Box) -> Box:
    """The common part; a null box if there is none."""
    p, q = _cols(a.bounds), _cols(b.bounds)
    return Box(*(F.greatest(p[k], q[k]) if k % 2 == 0 else F.least(p[k], q[k]) for k in range(6)))


def box_center(b: Box) -> Point:
    x0, x1, y0, y1, z0, z1 = _cols(b.bounds)
    return Point((x0 + x1) / 2, (y0 + y1) / 2, (z0 + z1) / 2)


def box_extents(b: Box) -> tuple[Column, Column]:
    """Shortest and longest side; 0 for a null box."""
    sides = box_lengths(b)
    return F.least(*sides), F.greatest(*sides)


def box_equals(a: Box, b: Box) -> Column:
    same = F.lit(True)
    for p, q in zip(_cols(a.bounds), _cols(b.bounds), strict=True):
        same = same & (p == q)
    return (box_is_null(a) & box_is_null(b)) | same


# shapes made from shapes: each returns a shape of Columns -------------------------------------------------------------


def _moved(b: Box, low: tuple, high: tuple) -> Box:
    null, c = box_is_null(b), _cols(b.bounds)
    return Box(*(F.when(null, v).otherwise(v + col((low if k % 2 == 0 else high)[k // 2])) for k, v in enumerate(c)))


def _by_axis(dx, dy, dz) -> tuple[Column, Column, Column]:
    return col(dx), col(dx if dy is None else dy), col(dx if dz is None else dz)


def box_expanded(b: Box, dx, dy=None, dz=None) -> Box:
    """By the same amount on both sides of each axis. A null box stays as it is."""
    d = _by_axis(dx, dy, dz)
    return _moved(b, tuple(-v for v in d), d)


def box_expanded_outwards(b: Box, dx, dy=None, dz=None) -> Box:
    """On the upper side of each axis only."""
    return _moved(b, (F.lit(0.0),) * 3, _by_axis(dx, dy, dz))


def box_translated(b: Box, dx, dy, dz) -> Box:
    d = (col(dx), col(dy), col(dz))
    return _moved(b, d, d)


def box_including(b: Box, other: Point | Box) -> Box:
    """Smallest box around both; a null one counts as nothing."""
    o = envelope(other)
    b_null, o_null, hull = box_is_null(b), box_is_null(o), box_hull(b, o)
    return Box(*(F.when(o_null, p).when(b_null, q).otherwise(h) for p, q, h in zip(_cols(b.bounds), o.bounds, hull.bounds, strict=True)))


def shell_equals(a: Shell, b: Shell) -> Column:
    same = (col(a.r_in) == col(b.r_in)) & (col(a.r_out) == col(b.r_out))
    return ~shell_is_null(a) & ~shell_is_null(b) & point_equals(a.center, b.center) & same


def shell_expanded(s: Shell, d) -> Shell:
    return Shell(s.center, col(s.r_in) + col(d), col(s.r_out) + col(d))


def shell_inner_expanded(s: Shell, d) -> Shell:
    """Inner radius moved out; a null shell where it passes the outer one."""
    grown, top = col(s.r_in) + col(d), col(s.r_out)
    gone = grown > top
    return Shell(s.center, F.when(gone, -1.0).otherwise(grown), F.when(gone, -1.0).otherwise(top))


def shell_outer_expanded(s: Shell, d) -> Shell:
    return Shell(s.center, col(s.r_in), col(s.r_out) + col(d))


def shell_including(s: Shell, other: Point | Shell) -> Shell:
    """Grown so that the argument is inside; of a shell that is not concentric the radii are null."""
    lo, hi = col(s.r_in), col(s.r_out)
    if isinstance(other, Point):
        d, inside = point_distance(s.center, other), point_in_shell(other, s)
        return Shell(s.center, F.when(~inside & (d < lo), d).otherwise(lo), F.when(inside | (d < lo), hi).otherwise(d + MARGIN))
    same, lo2, hi2 = point_equals(s.center, other.center), col(other.r_in), col(other.r_out)
    return Shell(s.center, F.when(same, F.least(lo, lo2)), F.when(same, F.when(hi2 >= hi, hi2 + MARGIN).otherwise(hi)))
