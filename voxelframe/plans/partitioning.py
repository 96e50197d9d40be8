"""Fitting a partitioner to a table, and labelling rows with it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.options import SpatialOptions, check_positive
from voxelframe.plans.base import Partitioner, sample_size
from voxelframe.plans.octree import OctreePartitioner
from voxelframe.plans.onion import OnionPartitioner

FITS = {"onion": OnionPartitioner.fit, "octree": OctreePartitioner.fit}


def fit(df: DataFrame, options: Mapping[str, str] | SpatialOptions, numPartitions: int, sampled: bool = False) -> Partitioner:
    """The partitioner of the options' grid type, fitted by one or two aggregates over the table.

    ``sampled`` counts an octree's cells on a sample, as large as the number of
    partitions asks for, instead of on all rows.
    """
    o = SpatialOptions.of(options)
    if sampled and o.gridtype == "octree":
        total = df.count()
        return OctreePartitioner.fit(df, o, check_positive(numPartitions), min(1.0, sample_size(total, numPartitions) / max(total, 1)))
    if o.gridtype not in FITS:
        raise AssertionError(f"Unknown grid type! Available grids: {', '.join(FITS)} (got {o.gridtype!r})")
    return FITS[o.gridtype](df, o, check_positive(numPartitions))


def prePartition(df: DataFrame, options: Mapping[str, str] | SpatialOptions, numPartitions: int = -1, name: str = "partition_id") -> DataFrame:
    """Adds an INT ``partition_id``. No row moves, except for ``current``.

    ``onion`` and ``octree`` label by the centre of the row (points and spheres
    alike); ``current`` deals the rows out evenly and labels them with the
    physical partition they land in. ``numPartitions=-1`` takes the number of
    partitions the table has now.
    """
    n = df.rdd.getNumPartitions() if numPartitions == -1 else check_positive(numPartitions)
    o = SpatialOptions.of(options)
    if o.gridtype == "current":
        return df.repartition(n).withColumn(name, F.spark_partition_id())
    return fit(df, o, n).place(df, name)


pre_partition = prePartition
