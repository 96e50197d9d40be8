"""Window queries: keep the rows whose shape meets a constant window. Narrow, no shuffle, ranges reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.coords import col
from voxelframe.functions.predicates import intersects
from voxelframe.options import is_spherical
from voxelframe.shapes import Box, Point, Shell

WINDOW_SIZES = {"point": 3, "sphere": 4, "shell": 5, "box": 9}
SLACK = 1e-9  # relative widening of the range prefilter: rounding must never drop a row


def center_columns(df: DataFrame, what: str, coords: Sequence[str] | None) -> list[str]:
    """The names of the three coordinate columns: ``coords``, or else all of a three-column table."""
    names = list(coords) if coords is not None else df.columns
    if len(names) != 3:
        raise AssertionError(f'Input DataFrame must have 3 columns to perform {what} (the coordinate center of objects). Use df.select("col1", "col2", "col3")')
    return names


def make_window(kind: str, coord: Sequence[float], spherical: bool):
    """The window as a shape."""
    if kind not in WINDOW_SIZES:
        raise AssertionError(f"windowType not understood! You must choose between: point, shell, sphere, box (got {kind!r})")
    if kind == "box" and spherical:
        raise AssertionError("Input Box coordinates must have cartesian coordinate!")
    if len(coord) < WINDOW_SIZES[kind]:
        raise IndexError(f"a {kind} window takes {WINDOW_SIZES[kind]} numbers, got {len(coord)}")
    v = [float(c) for c in coord]
    if kind == "box":
        return Box.of_points(*(Point(*v[k : k + 3]) for k in (0, 3, 6)))
    center = Point(*v[:3], spherical=spherical)
    return center if kind == "point" else Shell(center, 0.0, v[3]) if kind == "sphere" else Shell(center, v[3], v[4])


def prefilter(names: Sequence, window) -> Column | None:
    """Ranges implied by a shell window, which a scan can use; ``None`` if there are none."""
    if not isinstance(window, Shell) or window.is_null():
        return None
    r = window.r_out
    if window.center.spherical:  # |r - r0| <= distance
        pairs = [(names[0], window.center.x)]
    else:
        pairs = list(zip(names, window.center.xyz, strict=True))
    keep = None
    for name, c in pairs:
        slack = SLACK * (abs(c) + abs(r) + 1.0)
        c1 = (col(name) >= c - r - slack) & (col(name) <= c + r + slack)
        keep = c1 if keep is None else keep & c1
    return keep


def window_filter(df: DataFrame, row_shape, window) -> DataFrame:
    """Rows of any table whose per-row shape (point, shell or box of columns) meets the window; all columns stay.

    A row with a null coordinate meets nothing.
    """
    keep = intersects(row_shape, window)
    if isinstance(row_shape, Point) and (ranges := prefilter(row_shape.xyz, window)) is not None:
        keep = ranges & keep
    return df.where(keep)


def windowquery(df: DataFrame, windowtype: str, windowcoord: Sequence[float], coordSys: str, coords: Sequence[str] | None = None) -> DataFrame:
    """Rows inside a point, sphere, shell or box window.

    Without ``coords`` the table must have exactly three columns, and the result
    has them as DOUBLE. With ``coords`` naming the three coordinates, every
    column of the input is kept as it is. Duplicates are kept.
    """
    names = center_columns(df, "window query", coords)
    spherical = is_spherical(coordSys)
    window = make_window(windowtype, windowcoord, spherical)
    out = window_filter(df, Point(*(F.col(f"`{n}`") for n in names), spherical=spherical), window)
    return out if coords is not None else out.select(*(F.col(f"`{n}`").cast("double").alias(n) for n in names))


windowQuery = windowquery


def keep_metadata(df: DataFrame, hits: DataFrame, names: Sequence[str]) -> DataFrame:
    """Full rows of ``df`` whose coordinates are among ``hits`` (a semi join)."""
    return df.join(hits, list(names), "left_semi")
