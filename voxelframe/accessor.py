"""``df.voxel``: the operators as methods of a DataFrame. Importing this module adds the attribute."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame

from voxelframe.operators.balance import checkLoadBalancing
from voxelframe.operators.crossmatch import crossmatch_center, crossmatch_healpix
from voxelframe.operators.knn import knn
from voxelframe.operators.repartition import repartitionByCol
from voxelframe.operators.window import window_filter, windowquery
from voxelframe.options import SpatialOptions
from voxelframe.plans.partitioning import prePartition


class Voxel:
    def __init__(self, df: DataFrame):
        self.df = df

    def prePartition(self, options: Mapping[str, str] | SpatialOptions, numPartitions: int = -1) -> DataFrame:
        return prePartition(self.df, options, numPartitions)

    def repartitionByCol(self, colname: str, preLabeled: bool, numPartitions: int = -1) -> DataFrame:
        return repartitionByCol(self.df, colname, preLabeled, numPartitions)

    def checkLoadBalancing(self, kind: str = "frac", numberOfElements: int = -1) -> DataFrame:
        return checkLoadBalancing(self.df, kind, numberOfElements)

    def window(self, windowtype: str, windowcoord: Sequence[float], coordSys: str, **more) -> DataFrame:
        return windowquery(self.df, windowtype, windowcoord, coordSys, **more)

    def meeting(self, row, window) -> DataFrame:
        """Rows whose shape meets the window."""
        return window_filter(self.df, row, window)

    def knn(self, p: Sequence[float], k: int, coordSys: str, unique: bool = False, **more) -> DataFrame:
        return knn(self.df, p, k, coordSys, unique, **more)

    def near(self, other: DataFrame, eps: float, return_type: str = "AB", **more) -> DataFrame:
        return crossmatch_center(self.df, other, eps, return_type, **more)

    def same_pixel(self, other: DataFrame, nside: int, return_type: str = "AB", **more) -> DataFrame:
        return crossmatch_healpix(self.df, other, nside, return_type, **more)


def attach(*classes: type) -> None:
    """Give DataFrame classes the attribute ``voxel``."""
    for c in classes:
        made = cached_property(Voxel)
        made.__set_name__(c, "voxel")
        c.voxel = made


attach(DataFrame)
