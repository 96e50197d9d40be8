"""HEALPix RING pixel index as a Column (Gorski et al. 2005, ApJ 622, 759): no Python on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelframe.functions.coords import col, dec2theta, ra2phi


def ang2pix_ring(nside: int, theta, phi) -> Column:
    """RING index (LONG) of a direction given by polar angle and azimuth in radians."""
    if nside < 1:
        raise AssertionError(f"nside must be at least 1 (got {nside})")
    theta, phi = col(theta), col(phi)
    z = F.cos(theta)
    za = F.abs(z)
    turns = phi / F.lit(2.0 * math.pi)
    tt = (turns - F.floor(turns)) * 4.0  # azimuth in quarter turns, [0, 4)
    n, npix = F.lit(nside).cast("long"), 12 * nside * nside

    # equatorial belt: index of the ascending and descending edge lines
    up = F.floor(nside * (0.5 + tt) - nside * z * 0.75)
    down = F.floor(nside * (0.5 + tt) + nside * z * 0.75)
    ring = n + 1 + up - down
    shift = 1 - ring % 2
    inside = F.pmod(F.floor((up + down - nside + shift + 1) / 2).cast("long"), F.lit(4 * nside).cast("long"))
    belt = F.lit(2 * nside * (nside - 1)).cast("long") + (ring - 1) * 4 * nside + inside

    # polar caps
    part = tt - F.floor(tt)
    width = nside * F.sqrt(3.0 * (1.0 - za))
    a, b = F.floor(part * width), F.floor((1.0 - part) * width)
    cap_ring = a + b + 1
    along = F.floor(tt * cap_ring)
    north = 2 * cap_ring * (cap_ring - 1) + along
    south = F.lit(npix).cast("long") - 2 * cap_ring * (cap_ring + 1) + along
    return F.when(za <= 2.0 / 3.0, belt).when(z > 0, north).otherwise(south).cast("long")


def to_healpix(nside: int, y, z, thetaphi: bool = False) -> Column:
    """Pixel of a centre: ``(y, z)`` are RA and Dec in degrees, or theta and phi in radians if ``thetaphi``."""
    return ang2pix_ring(nside, y, z) if thetaphi else ang2pix_ring(nside, dec2theta(z), ra2phi(y))
