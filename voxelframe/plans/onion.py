"""Concentric shells of equal thickness around the origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.coords import radius
from voxelframe.options import SpatialOptions, check_positive
from voxelframe.plans.base import Partitioner
from voxelframe.shapes import Point, Shell

OUTERMOST = 1.1  # the last shell reaches this much further than the data


def max_radius(df: DataFrame, options: SpatialOptions) -> Column | float:
    """Largest distance of a centre to the origin: one aggregate, one row. 0 for a table without known centres."""
    r = radius([F.col(f"`{c}`") for c in options.center], options.spherical)
    value = df.agg(F.max(F.when(~F.isnan(r), r)).alias("r")).first()["r"]
    return 0.0 if value is None else float(value)


class OnionPartitioner(Partitioner):
    def __init__(self, num_partitions: int, max_r: float, options: SpatialOptions | None = None):
        self._n = check_positive(num_partitions)
        self.dz = max_r / num_partitions
        self.options = options or SpatialOptions(gridtype="onion")

    @classmethod
    def fit(cls, df: DataFrame, options: SpatialOptions, num_partitions: int) -> OnionPartitioner:
        return cls(check_positive(num_partitions), max_radius(df, options), options)

    @property
    def numPartitions(self) -> int:
        return self._n

    def label(self, x, y, z) -> Column:
        """The number of shell borders at or below the row's radius; past the last one (or NaN) is the last shell."""
        r, last = radius((x, y, z), self.options.spherical), F.lit(self._n - 1)
        known = x.isNotNull() & y.isNotNull() & z.isNotNull() if isinstance(x, Column) else F.lit(True)
        if self.dz <= 0 or self._n == 1:
            return F.when(known, last).cast("int")
        guess = F.floor(r / self.dz)
        # borders are the products i * dz: put right what the division rounded
        guess = guess + F.when((guess + 1) * self.dz <= r, 1).when(guess * self.dz > r, -1).otherwise(0)
        return F.when(~known, None).when(F.isnan(r) | (guess > last), last).when(guess < 0, 0).otherwise(guess).cast("int")

    def _place(self, r: float) -> int:
        for i in range(self._n - 1):
            if i * self.dz <= r < (i + 1) * self.dz:
                return i
        return self._n - 1

    def home(self, point: Sequence[float]) -> int:
        s = self.options.spherical
        return self._place(Point(*point, spherical=s).distance(Point(0.0, 0.0, 0.0, s)))

    def cells(self) -> list[tuple[int, Shell]]:
        origin = Point(0.0, 0.0, 0.0, self.options.spherical)
        top = [(i + 1) * self.dz * (OUTERMOST if i == self._n - 1 else 1.0) for i in range(self._n)]
        return [(i, Shell(origin, i * self.dz, top[i])) for i in range(self._n)]

    def cells_within(self, point: Sequence[float], r: float) -> list[int]:
        s = self.options.spherical
        d = Point(*point, spherical=s).distance(Point(0.0, 0.0, 0.0, s))
        slack = 1e-9 * (abs(d) + r + 1.0)
        return list(range(self._place(max(0.0, d - r - slack)), self._place(d + r + slack) + 1))

    def partition_nodes(self, shape) -> list[tuple[int, Shell]]:
        center = shape.center
        d = center.distance(Point(0.0, 0.0, 0.0, center.spherical))
        return [self.cells()[self._place(d)]]

    def neighbor_nodes(self, shape, inclusive: bool = False) -> list[tuple[int, Shell]]:
        own = self.partition_nodes(shape)
        return self.secondary_neighbor_nodes(own[0][1], own[0][0]) + (own if inclusive else [])

    def secondary_neighbor_nodes(self, cell, cell_id: int) -> list[tuple[int, Shell]]:
        grid = self.cells()
        return [grid[i] for i in (cell_id + 1, cell_id - 1) if 0 <= i < self._n]

    def place_object(self, shape) -> list[int]:
        return [i for i, _ in self.partition_nodes(shape)]

    def __eq__(self, other) -> bool:
        return isinstance(other, OnionPartitioner) and (self._n, self.dz) == (other._n, other.dz)

    __hash__ = Partitioner.__hash__
