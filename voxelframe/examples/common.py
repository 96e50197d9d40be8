"""Arguments that the command lines share."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from voxelframe.operators.repartition import repartitionByCol
from voxelframe.plans.partitioning import prePartition
from voxelframe.session import get_session, set_log_level
from voxelframe.sources.readers import load


def parser(text: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=text)
    p.add_argument("path", help="table by path: FITS, CSV, Parquet, JSON or ORC")
    p.add_argument("--columns", default="x,y,z", help="the three coordinates, by commas")
    p.add_argument("--spherical", action="store_true", help="coordinates are r, theta, phi")
    p.add_argument("--grid", choices=("onion", "octree", "current"), help="partition the table this way first")
    p.add_argument("--partitions", type=int, default=-1)
    p.add_argument("--picture", help="write a scatter plot to this file (needs matplotlib)")
    return p


def session() -> SparkSession:
    spark = get_session()
    set_log_level(spark)
    return spark


def coordinates(args: argparse.Namespace) -> list[str]:
    return [c.strip() for c in args.columns.split(",")]


def system(args: argparse.Namespace) -> str:
    return "spherical" if args.spherical else "cartesian"


def labelled(spark: SparkSession, args: argparse.Namespace, grid: str | None = None) -> DataFrame:
    df = load(spark, args.path)
    grid = grid or args.grid
    return df if grid is None else prePartition(df, {"geometry": "points", "colnames": args.columns, "coordSys": system(args), "gridtype": grid}, args.partitions)


def placed(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The table, dealt out by grid cell if a grid is asked for."""
    df = labelled(spark, args)
    return df if args.grid is None else repartitionByCol(df, "partition_id", True)


def draw(path: str, sets: Sequence[tuple[str, DataFrame]], names: Sequence[str], most: int = 10_000) -> None:
    """Each result as one colour; at most ``most`` rows of each."""
    from voxelframe.plotting import scatter3d_mpl

    ax = None
    for label, df in sets:
        rows = df.select(*(f"`{n}`" for n in names)).limit(most).toPandas()
        ax = scatter3d_mpl(*(rows[n] for n in names), label=label, axIn=ax)
    ax.legend()
    ax.figure.savefig(path)
