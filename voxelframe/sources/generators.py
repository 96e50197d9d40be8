"""Seeded synthetic tables. Rows are drawn on the executors; sizes are not bounded by the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPREAD = 10.0


def _center(coordSys: str, seed: int) -> list[Column]:
    scale = (1.0, math.pi, 2 * math.pi) if coordSys == "spherical" else (1.0, 1.0, 1.0)
    return [F.rand(seed + k) * s for k, s in enumerate(scale)]


def points(spark: SparkSession, n: int, coordSys: str = "cartesian", seed: int = 0) -> DataFrame:
    """``x,y,z`` uniform in [0,1), or ``Z_COSMO,RA,DEC`` as (r, theta, phi)."""
    names = ("Z_COSMO", "RA", "DEC") if coordSys == "spherical" else ("x", "y", "z")
    return spark.range(n).select(*(c.alias(m) for c, m in zip(_center(coordSys, seed), names, strict=True)))


def spheres(spark: SparkSession, n: int, coordSys: str = "cartesian", seed: int = 0, scale: float = 0.01) -> DataFrame:
    names = ("Z_COSMO", "RA", "DEC") if coordSys == "spherical" else ("x", "y", "z")
    return spark.range(n).select(*(c.alias(m) for c, m in zip(_center(coordSys, seed), names, strict=True)), (F.rand(seed + 3) * scale).alias("radius"))


def blobs(spark: SparkSession, n: int, centers: int = 3, std: float = 1.0, seed: int = 0) -> DataFrame:
    """Gaussian clusters with centres in (-10, 10) on each axis; ``label`` names the cluster."""
    who = (F.rand(seed) * centers).cast("int")
    df = spark.range(n).select(who.alias("label"))
    spot = [(F.pmod(F.xxhash64(F.col("label"), F.lit(seed * 3 + k)), F.lit(1_000_003)) / 1_000_003.0) * 2 * SPREAD - SPREAD for k in range(3)]
    return df.select(*((spot[k] + F.randn(seed + 1 + k) * std).alias(m) for k, m in enumerate("xyz")), "label")


def many_columns(spark: SparkSession, n: int, ncols: int, seed: int = 0) -> DataFrame:
    """``col0`` in [0,1), ``col1`` in [0,pi), ``col2`` in [0,2pi), the others in [0,1)."""
    scale = (1.0, math.pi, 2 * math.pi)
    return spark.range(n).select(*((F.rand(seed + k) * (scale[k] if k < 3 else 1.0)).alias(f"col{k}") for k in range(ncols)))
