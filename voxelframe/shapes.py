"""Immutable shapes used at plan time: points, shells (spheres) and axis-aligned boxes.

Shapes are values; operations that would change one return a new one. The same
classes also carry Columns or column names in their fields, in which case only
:mod:`voxelframe.functions.predicates` may look at them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Any

from voxelframe.functions.coords import sph2cart

MARGIN = 0.1  # how far an outer radius is set beyond what it has to include


@dataclass(frozen=True)
class Point:
    x: Any
    y: Any
    z: Any
    spherical: bool = False

    @property
    def xyz(self) -> tuple:
        return self.x, self.y, self.z

    @property
    def center(self) -> Point:
        return self

    coordinates = xyz

    def volume(self) -> float:
        return 0.0

    def cartesian(self) -> Point:
        return Point(*sph2cart(*self.xyz)) if self.spherical else self

    def equals(self, other: Point) -> bool:
        """Same coordinates, whatever the coordinate systems."""
        return self.xyz == other.xyz

    def distance(self, other: Point) -> float:
        if self.spherical != other.spherical:
            raise AssertionError("Points must have the same coordinate system!")
        if not self.spherical:
            return math.sqrt(sum((a - b) * (a - b) for a, b in zip(self.xyz, other.xyz, strict=True)))
        (r1, t1, p1), (r2, t2, p2) = self.xyz, other.xyz
        angle = math.sin(t1) * math.sin(t2) * math.cos(p1 - p2) + math.cos(t1) * math.cos(t2)
        return math.sqrt(max(0.0, r1 * r1 + r2 * r2 - 2.0 * r1 * r2 * angle))

    def close_to(self, other: Point, eps: float) -> bool:
        return self.distance(other.center) <= eps

    def envelope(self) -> Box:
        x, y, z = self.cartesian().xyz
        return Box(x, x, y, y, z, z)

    def intersects(self, other) -> bool:
        if isinstance(other, Point):
            return self.equals(other)
        if isinstance(other, Shell):
            return other.contains_point(self)
        if isinstance(other, Box):
            return other.contains_point(self)
        raise AssertionError("Cannot perform intersection because the type of shape is unknown!")

    def hash_code(self) -> int:
        return hash((self.xyz, self.envelope()))


@dataclass(frozen=True)
class Shell:
    """All points at ``r_in <= d < r_out`` from the centre; a sphere has ``r_in = 0``."""

    center: Point
    r_in: Any
    r_out: Any

    @classmethod
    def of(cls, x, y, z, spherical: bool, r_in, r_out) -> Shell:
        return cls(Point(x, y, z, spherical), r_in, r_out)

    @classmethod
    def sphere(cls, center: Point, r) -> Shell:
        return cls(center, 0.0, r)

    @classmethod
    def null(cls) -> Shell:
        return cls(Point(0.0, 0.0, 0.0, True), -1.0, -2.0)

    def is_null(self) -> bool:
        return self.r_in < 0 or self.r_out < 0 or self.r_in > self.r_out

    def to_null(self) -> Shell:
        return replace(self, r_in=-1.0, r_out=-1.0)

    def area(self) -> float:
        return 0.0 if self.is_null() else 4.0 * math.pi * (self.r_out * self.r_out - self.r_in * self.r_in)

    def including(self, other: Point | Shell) -> Shell:
        """Grown so that the argument is inside; a concentric shell is required."""
        if isinstance(other, Point):
            if self.contains_point(other):
                return self
            d = self.center.distance(other)
            return replace(self, r_in=d) if d < self.r_in else replace(self, r_out=d + MARGIN)
        if not self.center.equals(other.center):
            raise AssertionError("The center of the two shells must match to expand one to the other!")
        if other.r_out >= self.r_out:
            return replace(self, r_in=min(self.r_in, other.r_in), r_out=other.r_out + MARGIN)
        return replace(self, r_in=other.r_in) if other.r_in < self.r_in else self

    def expanded(self, d) -> Shell:
        return replace(self, r_in=self.r_in + d, r_out=self.r_out + d)

    def inner_expanded(self, d) -> Shell:
        grown = replace(self, r_in=self.r_in + d)
        return self.to_null() if grown.r_in > grown.r_out else grown

    def outer_expanded(self, d) -> Shell:
        return replace(self, r_out=self.r_out + d)

    def equals(self, other: Shell) -> bool:
        return not self.is_null() and not other.is_null() and self.center.equals(other.center) and (self.r_in, self.r_out) == (other.r_in, other.r_out)

    def envelope(self) -> Box:
        (x, y, z), r = self.center.cartesian().xyz, self.r_out
        return Box(x - r, x + r, y - r, y + r, z - r, z + r)

    def contains_point(self, p: Point) -> bool:
        return not self.is_null() and self.r_in <= self.center.distance(p) < self.r_out

    def contains(self, other: Shell) -> bool:
        """True if the argument lies in the hole of this shell."""
        return not self.is_null() and not other.is_null() and self.center.distance(other.center) + other.r_out <= self.r_in

    def intersects(self, other) -> bool:
        if isinstance(other, Point):
            return self.contains_point(other)
        if isinstance(other, Box):
            return not self.is_null() and other.intersects(self.envelope())
        if isinstance(other, Shell):
            if self.is_null() or other.is_null():
                return False
            d = self.center.distance(other.center)
            return not (d + other.r_out < self.r_in or d + self.r_out < other.r_in) and d <= self.r_out + other.r_out
        raise AssertionError("Cannot perform intersection because the type of shape is unknown!")

    def close_to(self, p: Point, eps: float) -> bool:
        return self.center.close_to(p, eps)

    def hash_code(self) -> int:
        return hash((self.center.xyz, self.envelope()))


@dataclass(frozen=True)
class Box:
    """Axis-aligned cartesian box; ``partition_id`` is set on the cells of a grid and is no part of its identity."""

    min_x: Any
    max_x: Any
    min_y: Any
    max_y: Any
    min_z: Any
    max_z: Any

    @classmethod
    def of(cls, x1, x2, y1, y2, z1, z2) -> Box:
        return cls(min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2), min(z1, z2), max(z1, z2))

    @classmethod
    def of_points(cls, *points: Point) -> Box:
        if any(p.spherical for p in points):
            raise AssertionError("Input Box coordinates must have cartesian coordinate!")
        (xs, ys, zs) = zip(*(p.xyz for p in points), strict=True)
        return cls(min(xs), max(xs), min(ys), max(ys), min(zs), max(zs))

    @classmethod
    def null(cls) -> Box:
        return cls(0.0, -1.0, 0.0, -1.0, 0.0, -1.0)

    to_null = null

    @property
    def bounds(self) -> tuple:
        return self.min_x, self.max_x, self.min_y, self.max_y, self.min_z, self.max_z

    @property
    def center(self) -> Point:
        return Point((self.min_x + self.max_x) / 2, (self.min_y + self.max_y) / 2, (self.min_z + self.max_z) / 2)

    def is_null(self) -> bool:
        return self.min_x > self.max_x or self.min_y > self.max_y or self.min_z > self.max_z

    def lengths(self) -> tuple[float, float, float]:
        return (0.0, 0.0, 0.0) if self.is_null() else (self.max_x - self.min_x, self.max_y - self.min_y, self.max_z - self.min_z)

    def min_extent(self) -> float:
        return min(self.lengths())

    def max_extent(self) -> float:
        return max(self.lengths())

    def volume(self) -> float:
        return math.prod(self.lengths())

    def _moved(self, low: tuple, high: tuple) -> Box:
        if self.is_null():
            return self
        b = self.bounds
        return Box(*(b[k] + (low if k % 2 == 0 else high)[k // 2] for k in range(6)))

    def expanded(self, dx, dy=None, dz=None) -> Box:
        """By the same amount on both sides of each axis."""
        d = (dx, dx if dy is None else dy, dx if dz is None else dz)
        return self._moved(tuple(-v for v in d), d)

    def expanded_outwards(self, dx, dy=None, dz=None) -> Box:
        """On the upper side of each axis only."""
        return self._moved((0.0, 0.0, 0.0), (dx, dx if dy is None else dy, dx if dz is None else dz))

    def translated(self, dx, dy, dz) -> Box:
        return self._moved((dx, dy, dz), (dx, dy, dz))

    def including(self, other: Point | Box) -> Box:
        other = other.envelope()
        return self if other.is_null() else other if self.is_null() else self._hull(other)

    def _hull(self, o: Box) -> Box:
        return Box(*((min if k % 2 == 0 else max)(a, b) for k, (a, b) in enumerate(zip(self.bounds, o.bounds, strict=True))))

    def intersection(self, other: Box) -> Box | None:
        """The hull of both (the name is historical), ``None`` if either is null. See :meth:`overlap`."""
        return None if self.is_null() or other.is_null() else self._hull(other)

    def overlap(self, other: Box) -> Box:
        """The common part, a null box if there is none."""
        return Box(*((max if k % 2 == 0 else min)(a, b) for k, (a, b) in enumerate(zip(self.bounds, other.bounds, strict=True))))

    def equals(self, other: Box) -> bool:
        return self.is_null() and other.is_null() or self.bounds == other.bounds

    def envelope(self) -> Box:
        return self

    def contains_point(self, p: Point) -> bool:
        if p.spherical:
            raise AssertionError("Input Box coordinates must have cartesian coordinate!")
        return not self.is_null() and self.contains_xyz(*p.xyz)

    def contains_xyz(self, x, y, z) -> bool:
        return self.min_x <= x < self.max_x and self.min_y <= y < self.max_y and self.min_z <= z < self.max_z

    def covers(self, other: Point | Box) -> bool:
        if isinstance(other, Point):
            return self.contains_point(other)
        pairs = ((0, 1), (2, 3), (4, 5))
        return not self.is_null() and not other.is_null() and all(other.bounds[i] >= self.bounds[i] and other.bounds[j] < self.bounds[j] for i, j in pairs)

    contains = covers

    def intersects(self, other) -> bool:
        if isinstance(other, Point):
            return self.contains_point(other)
        if isinstance(other, Shell):
            return other.intersects(self)
        if isinstance(other, Box):
            p, q = self.bounds, other.bounds
            return not other.is_null() and not any(q[k] >= p[k + 1] or q[k + 1] < p[k] for k in (0, 2, 4))
        raise AssertionError("Cannot perform intersection because the type of shape is unknown!")

    def intersects_region(self, p1: Point, p2: Point, p3: Point) -> bool:
        return not self.is_null() and self.intersects(Box.of_points(p1, p2, p3))

    def distance(self, other: Box) -> float:
        if self.intersects(other):
            return 0.0
        p, q = self.bounds, other.bounds
        return math.sqrt(sum(max(q[k] - p[k + 1], p[k] - q[k + 1], 0.0) ** 2 for k in (0, 2, 4)))

    def close_to(self, p: Point, eps: float) -> bool:
        return self.center.close_to(p, eps)

    def hash_code(self) -> int:
        return hash((self.center.xyz, self.bounds))

    def __str__(self) -> str:
        x0, x1, y0, y1, z0, z1 = self.bounds
        return f"Env[{x0} : {x1}, {y0} : {y1}, {z0} : {z1}, ]"
