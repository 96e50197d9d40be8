"""Coordinate and distance expressions. Everything returns a Column (or works on any value with arithmetic)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_PI = math.pi / 2.0
DEGREE = math.pi / 180.0


def col(value: Column | str | float | int) -> Column:
    """A DOUBLE Column from a column name, a Column or a number."""
    if isinstance(value, Column):
        return value.cast("double")
    if isinstance(value, str):
        return F.col(value).cast("double")
    return F.lit(float(value))


def triple(values) -> tuple[Column, Column, Column]:
    x, y, z = values
    return col(x), col(y), col(z)


def distance_cartesian(a, b) -> Column:
    """Euclidean distance; products rather than powers, so that results are bit-equal to plain IEEE code."""
    (ax, ay, az), (bx, by, bz) = triple(a), triple(b)
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def distance_spherical(a, b) -> Column:
    """Distance of two (r, theta, phi) triples. A radicand below zero by rounding counts as zero; NaN stays NaN."""
    (r1, t1, p1), (r2, t2, p2) = triple(a), triple(b)
    angle = F.sin(t1) * F.sin(t2) * F.cos(p1 - p2) + F.cos(t1) * F.cos(t2)
    return F.sqrt(F.greatest(F.lit(0.0), r1 * r1 + r2 * r2 - F.lit(2.0) * r1 * r2 * angle))


def distance(a, b, spherical: bool = False) -> Column:
    return distance_spherical(a, b) if spherical else distance_cartesian(a, b)


def radius(point, spherical: bool = False) -> Column:
    """Distance to the origin."""
    x, y, z = triple(point)
    return F.sqrt(x * x) if spherical else F.sqrt(x * x + y * y + z * z)


def cartesian_to_spherical(x, y, z) -> tuple[Column, Column, Column]:
    x, y, z = triple((x, y, z))
    flat = x * x + y * y
    return F.sqrt(flat + z * z), F.atan2(F.sqrt(flat), z), F.atan2(y, x)


def spherical_to_cartesian(r, theta, phi) -> tuple[Column, Column, Column]:
    r, theta, phi = triple((r, theta, phi))
    flat = r * F.sin(theta)
    return flat * F.cos(phi), flat * F.sin(phi), r * F.cos(theta)


def dec2theta(dec, in_radian: bool = False) -> Column:
    """Declination to polar angle, in radians."""
    return F.lit(HALF_PI) - (col(dec) if in_radian else F.lit(DEGREE) * col(dec))


def ra2phi(ra, in_radian: bool = False) -> Column:
    """Right ascension to azimuth, in radians."""
    return col(ra) if in_radian else F.lit(DEGREE) * col(ra)


def sph2cart(r: float, theta: float, phi: float) -> tuple[float, float, float]:
    """Plain Python counterpart of :func:`spherical_to_cartesian`, for one point."""
    return r * math.sin(theta) * math.cos(phi), r * math.sin(theta) * math.sin(phi), r * math.cos(theta)


def cart2sph(x: float, y: float, z: float) -> tuple[float, float, float]:
    """Plain Python counterpart of :func:`cartesian_to_spherical`, for one point."""
    flat = x * x + y * y
    return math.sqrt(flat + z * z), math.atan2(math.sqrt(flat), z), math.atan2(y, x)
