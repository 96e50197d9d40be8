"""What every spatial partitioner offers. A partitioner is a plan-time object; it labels rows with native Columns."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.options import SpatialOptions
from voxelframe.shapes import Box, Shell

SAMPLE_FLOOR = 5000


def sample_size(total: int, num_partitions: int) -> int:
    """How many of ``total`` rows describe the data well enough to cut it into so many partitions."""
    return total if total < SAMPLE_FLOOR else max(SAMPLE_FLOOR, 2 * num_partitions, total // 100)


class Partitioner(ABC):
    options: SpatialOptions

    @property
    @abstractmethod
    def numPartitions(self) -> int: ...

    @abstractmethod
    def label(self, x, y, z) -> Column:
        """INT id of the cell of a centre; null if a coordinate is null."""

    @abstractmethod
    def home(self, point: Sequence[float]) -> int:
        """The same for one point, at plan time."""

    @abstractmethod
    def cells(self) -> list[tuple[int, Box | Shell]]: ...

    @abstractmethod
    def cells_within(self, point: Sequence[float], r: float) -> list[int]:
        """Ids of all cells that may hold a row at most ``r`` from the point."""

    @abstractmethod
    def partition_nodes(self, shape) -> list[tuple[int, Box | Shell]]:
        """Cells the shape belongs to."""

    @abstractmethod
    def neighbor_nodes(self, shape, inclusive: bool = False) -> list[tuple[int, Box | Shell]]: ...

    @abstractmethod
    def secondary_neighbor_nodes(self, cell, cell_id: int) -> list[tuple[int, Box | Shell]]: ...

    def place(self, df: DataFrame, name: str = "partition_id") -> DataFrame:
        """The table with the label of each row's centre."""
        return df.withColumn(name, self.label(*(F.col(f"`{c}`") for c in self.options.center)))

    def __hash__(self) -> int:
        return self.numPartitions
