"""How evenly the rows of a table are spread over its physical partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.session import ship_package


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({"n": pa.array([sum(b.num_rows for b in batches)], pa.int64())})


def checkLoadBalancing(df: DataFrame, kind: str = "frac", numberOfElements: int = -1) -> DataFrame:
    """One row per physical partition, empty ones included: its load and its id.

    ``frac``: percent of all rows in ``Load (%)``; ``size``: rows in
    ``Load (#Rows)``; both DOUBLE. ``numberOfElements`` saves the count for
    ``frac``.
    """
    if kind not in ("frac", "size"):
        raise AssertionError(f"Wrong value for `kind`: {kind!r}; take 'frac' (percent of all rows) or 'size' (rows)")
    if numberOfElements != -1 and numberOfElements <= 0:
        raise AssertionError(f"Total number of elements must be greater than 0, or -1 to have it counted (got {numberOfElements})")
    if kind == "frac" and numberOfElements == -1:
        numberOfElements = df.count()
    # a constant column: only row counts cross to Python, and it keeps the scan from reading the others
    ship_package(df.sparkSession)
    counts = df.select(F.lit(1).cast("byte").alias("one")).mapInArrow(_sizes, "n long")
    load = F.col("n").cast("double")
    named = (load * 100.0 / F.lit(float(max(1, numberOfElements)))).alias("Load (%)") if kind == "frac" else load.alias("Load (#Rows)")
    return counts.select(named, F.spark_partition_id().alias("partition_id"))


def label_load(df: DataFrame, label: str = "partition_id") -> DataFrame:
    """Rows and percent per label, in one aggregate; the check to run before the exchange."""
    rows = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    return rows.select(label, "n_rows", (F.col("n_rows") * 100.0 / rows.agg(F.sum("n_rows")).scalar()).alias("load_pct"))
