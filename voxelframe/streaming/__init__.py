"""Spatial operators on unbounded tables.

Windows, labels, scalars and predicates are stateless Columns, so they apply to
a stream unchanged; this module adds the two stateful forms a stream needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.window import windowquery
from voxelframe.plans.base import Partitioner


def stream_window(stream: DataFrame, windowtype: str, windowcoord: Sequence[float], coordSys: str, coords: Sequence[str]) -> DataFrame:
    """Rows of a stream inside a window; stateless."""
    return windowquery(stream, windowtype, windowcoord, coordSys, coords=coords)


def stream_labels(stream: DataFrame, partitioner: Partitioner, name: str = "partition_id") -> DataFrame:
    """A stream labelled by a grid that was fitted on a batch; stateless."""
    return partitioner.place(stream, name)


def stream_cell_counts(stream: DataFrame, partitioner: Partitioner, time: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows per grid cell and event-time window, with late rows admitted for ``late``; state is bounded by the watermark."""
    labelled = partitioner.place(stream.withWatermark(time, late), "partition_id")
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return labelled.groupBy(span.alias("span"), "partition_id").agg(F.count("*").alias("n_rows"))
