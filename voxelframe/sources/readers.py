"""Reading by format or extension, and converting between formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelframe.sources import fits

EXTENSIONS = {".fits": "fits", ".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def load(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A table by path; the format comes from the extension unless given. CSV has a header and inferred types by default."""
    if fmt is None:
        fmt = next((f for e, f in EXTENSIONS.items() if path.rstrip("/").endswith(e)), None)
        if fmt is None:
            raise AssertionError(f"Input file must have one of the extensions {', '.join(EXTENSIONS)}: {path}")
    if fmt == "fits":
        fits.register(spark)
    if fmt == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.format(fmt).options(**options).load(path)


def save(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """Write as csv, txt (space-separated with header), json or parquet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "txt":
        w.option("header", True).option("sep", " ").csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.option("compression", "snappy").parquet(path)
    else:
        raise AssertionError(f"Output format not understood! You must choose between: csv, json, txt, parquet (got {fmt!r})")


def convert(spark: SparkSession, source: str, target: str, fmt: str, hdu: int = 1) -> None:
    """FITS table to csv, txt, json or parquet."""
    save(load(spark, source, "fits", hdu=hdu), target, fmt)
