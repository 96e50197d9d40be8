"""k nearest rows to a target: a bounded top-k per task and a merge (``TakeOrderedAndProject``), no shuffle of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.coords import col, distance
from voxelframe.functions.predicates import box_center as center
from voxelframe.operators.window import center_columns
from voxelframe.options import is_spherical
from voxelframe.plans.base import Partitioner
from voxelframe.shapes import Box, Point, Shell

FIRST_TRY, LAST_TRY = 4, 1_000_000  # rows looked at for each distinct one at first; rows looked at in one bounded top-m at most


def _nearest(df: DataFrame, names: Sequence[str], target: Sequence[float], k: int, spherical: bool) -> DataFrame:
    cols = [F.col(f"`{n}`") for n in names]
    known = F.lit(True)
    for c in cols:
        known = known & c.isNotNull()
    d: Column = distance(cols, target, spherical)
    return df.where(known).orderBy(d, *cols).limit(k)


def _nearest_distinct(df: DataFrame, names: Sequence[str], target: Sequence[float], k: int, spherical: bool) -> DataFrame:
    """The k nearest distinct centres, without a shuffle of the table where copies are few.

    The m nearest rows hold the nearest distinct centres complete, so it is
    enough to find an m with k distinct ones among them; each try is a bounded
    top-m. Where copies crowd out even the largest m, the table has few distinct
    centres near the target, and a partial aggregation per task is the better plan.
    """
    m = max(FIRST_TRY * k, 1000)
    while 0 < k and m <= LAST_TRY:
        near = _nearest(df, names, target, m, spherical)
        row = near.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*(F.col(f"`{n}`") for n in names))).alias("distinct")).first()
        if row["distinct"] >= k or row["n"] < m:
            return _nearest(near.dropDuplicates(list(names)), names, target, k, spherical)
        m *= 10
    return _nearest(df.dropDuplicates(list(names)), names, target, k, spherical)


def knn(df: DataFrame, p: Sequence[float], k: int, coordSys: str, unique: bool = False, coords: Sequence[str] | None = None, shape: Point | Shell | Box | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``p`` by centre distance, nearest first; ties go by the coordinates.

    ``unique`` counts rows with equal coordinates once, and then always returns
    ``min(k, number of distinct centres)`` rows. Without ``coords`` the table
    must have three columns and they come back as DOUBLE; with ``coords`` all
    columns are kept. With ``shape`` (of columns, one per row) rows are points,
    shells or boxes, placed by their centres, and all columns are kept. Rows with
    a null coordinate are never near anything.
    """
    if shape is not None:
        point = shape if isinstance(shape, Point) else center(shape) if isinstance(shape, Box) else shape.center
        named = df.withColumns({f"__center_{n}": col(c).cast("double") for n, c in zip("xyz", point.xyz, strict=True)})
        names = [f"__center_{n}" for n in "xyz"]
        return knn(named, p, k, coordSys, unique, names).drop(*names)
    names = center_columns(df, "KNN", coords)
    spherical = is_spherical(coordSys)
    if len(p) < 3:
        raise IndexError(f"the target takes 3 numbers, got {len(p)}")
    if coords is None:
        df = df.select(*(F.col(f"`{n}`").cast("double").alias(n) for n in names))
    return (_nearest_distinct if unique else _nearest)(df, names, list(p)[:3], k, spherical)


KNN = knn


def knn_pruned(df: DataFrame, p: Sequence[float], k: int, partitioner: Partitioner, label: str = "partition_id") -> DataFrame:
    """Exact KNN over a table labelled by ``partitioner``, reading only the cells that can matter.

    First the k nearest of the target's own cell bound the answer's radius;
    then only cells that meet this sphere are scanned. On a table written with
    ``partitionBy(label)`` both steps prune whole directories. If the home cell
    holds fewer than k rows, every cell is scanned.
    """
    names, spherical = partitioner.options.center, partitioner.options.spherical
    home = partitioner.home(p)
    near = _nearest(df.where(F.col(label) == home), names, p, k, spherical).select(distance([F.col(n) for n in names], p, spherical).alias("d"))
    row = near.agg(F.count("*").alias("n"), F.max("d").alias("r")).first()
    if row["n"] >= k > 0:
        df = df.where(F.col(label).isin(partitioner.cells_within(p, row["r"])))
    return _nearest(df, names, p, k, spherical)
