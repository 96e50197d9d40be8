"""Three-dimensional analytics on Spark DataFrames: windows, nearest neighbours, matches, grids and exact repartitioning."""

from voxelframe.functions.coords import cart2sph, dec2theta, ra2phi, sph2cart
from voxelframe.functions.healpix import to_healpix
from voxelframe.operators.balance import checkLoadBalancing
from voxelframe.operators.collapse import CollapseFunctions, collapse_rdd_data
from voxelframe.operators.crossmatch import crossmatch_center, crossmatch_healpix
from voxelframe.operators.knn import knn, knn_pruned
from voxelframe.operators.repartition import repartitionByCol
from voxelframe.operators.window import window_filter, windowquery
from voxelframe.options import SpatialOptions
from voxelframe.plans.partitioning import fit, prePartition
from voxelframe.session import get_session, set_log_level
from voxelframe.shapes import Box, Point, Shell

__all__ = [
    "Box", "CollapseFunctions", "Point", "Shell", "SpatialOptions", "cart2sph", "checkLoadBalancing", "collapse_rdd_data",
    "crossmatch_center", "crossmatch_healpix", "dec2theta", "fit", "get_session", "knn", "knn_pruned", "prePartition", "ra2phi",
    "repartitionByCol", "set_log_level", "sph2cart", "to_healpix", "window_filter", "windowquery",
]
