"""Validated options shared by the spatial operators.

The error texts carry the key phrases users of comparable engines match on;
all of them are raised as ``AssertionError``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

GEOMETRIES = ("points", "spheres")
COORD_SYSTEMS = ("cartesian", "spherical")
GRID_TYPES = ("onion", "octree", "current")


def is_spherical(coord_sys: str) -> bool:
    """True for ``spherical``, False for ``cartesian``; anything else is an error."""
    if coord_sys not in COORD_SYSTEMS:
        raise AssertionError(f"Coordinate system not understood! You must choose between: spherical, cartesian (got {coord_sys!r})")
    return coord_sys == "spherical"


def check_positive(num_partitions: int) -> int:
    if num_partitions <= 0:
        raise AssertionError(
            "The number of partitions must be strictly greater than zero! Otherwise leave it unset "
            f"to take the number of partitions of the input DataFrame (got {num_partitions})."
        )
    return num_partitions


@dataclass(frozen=True)
class SpatialOptions:
    """Where the coordinates of a table are and how a grid should cut them."""

    geometry: str = "points"
    colnames: tuple[str, ...] = ("x", "y", "z")
    coordSys: str = "cartesian"
    gridtype: str = "octree"

    def __post_init__(self) -> None:
        if self.gridtype not in GRID_TYPES:
            raise AssertionError(f"Gridtype not understood! You must choose between: onion, octree, or current (got {self.gridtype!r})")
        if self.gridtype == "current":
            return
        is_spherical(self.coordSys)
        if self.geometry not in GEOMETRIES:
            raise AssertionError(f"Geometry not understood! You must choose between: points or spheres (got {self.geometry!r})")
        wanted = 3 if self.geometry == "points" else 4
        if len(self.colnames) != wanted:
            raise AssertionError(f"colnames must name {wanted} columns for geometry {self.geometry!r}, got {list(self.colnames)}")

    @classmethod
    def of(cls, options: Mapping[str, str] | SpatialOptions) -> SpatialOptions:
        """From a string map such as ``{"geometry": "points", "colnames": "x,y,z", ...}``."""
        if isinstance(options, cls):
            return options
        names = options.get("colnames", "x,y,z")
        if isinstance(names, str):
            names = names.split(",")
        return cls(
            geometry=options.get("geometry", "points"),
            colnames=tuple(n.strip() for n in names),
            coordSys=options.get("coordSys", "cartesian"),
            gridtype=options.get("gridtype", "octree"),
        )

    @property
    def spherical(self) -> bool:
        return is_spherical(self.coordSys)

    @property
    def center(self) -> tuple[str, str, str]:
        return self.colnames[:3]  # type: ignore[return-value]
