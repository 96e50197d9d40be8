"""Shared pieces: reading tables, cutting lineage in the shared folder, joins that check what they broadcast."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from voxelframe.session import ship_package

#: Most rows of a lookup table that is broadcast; its rows are a few dozen bytes, so this is some tens of MB. Beyond it the join shuffles.
BROADCAST_ROWS = 200_000
BATCH_BYTES = 4 << 20  # of an Arrow batch on its way to Python
SLICE = 256  # texts of an Arrow batch that are Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or a temporary one where it is unset and there is one machine only (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="voxelframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_written: list[str] = []  # scratch tables that are still there


def saved(df: DataFrame, what: str) -> DataFrame:
    """The table written to the shared folder and read back: computed once, no lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    _written.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def drop_saved(df: DataFrame) -> None:
    """Delete what :func:`saved` wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def scratch_so_far() -> set[str]:
    return set(_written)


def clear_scratch(spark: SparkSession, before: set[str], keep: DataFrame | None = None) -> None:
    """Delete what was saved since ``before``, but for ``keep``.

    Operators return lazy tables that read what they saved, so they cannot clear
    up themselves; who has written their result can.
    """
    kept = getattr(keep, "_scratch", None)
    for path in [p for p in _written if p not in before and p != kept]:
        _delete(spark, path)


def lookup(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large table with a saved lookup table that has one row per key.

    Up to ``limit`` rows the lookup table is broadcast. Beyond that both sides
    shuffle, and adaptive execution splits a key that holds a large part of the
    rows over several tasks. Both ways give the same rows.
    """
    return df.join(bounded(small, small.count(), limit), on, how)


def bounded(small: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table, of at most so many rows, with the hint by which a join broadcasts it up to ``limit`` and never beyond: without one Spark goes by the bytes of compressed files."""
    return F.broadcast(small) if rows <= limit else small.hint("merge")


def in_blocks(rows: DataFrame, keys: list[str], member: str, block: int, attach: DataFrame | None = None) -> DataFrame:
    """Rows of groups with two members or more, dealt out for comparison within the group.

    A group of up to ``block`` rows is one unit. A larger one is cut into blocks
    by the hash of ``member`` (its number is ``own``), and each pair of blocks
    ``(lo, hi)`` is a unit, so no task ever holds more than about two blocks,
    however large a group is. ``attach`` is joined by ``member`` to what is left.
    The result is partitioned by unit and sorted, ready for :func:`whole_groups`.

    Both joins shuffle: the size of what Python or an explode makes is not known
    to Spark, which takes it for that of its input and would broadcast millions of keys.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    parts = F.ceil(F.col("__n") / F.lit(block))
    own, other = F.pmod(F.xxhash64(member), F.col("__parts")), F.col("__other")
    cut = rows.join(counts.hint("merge"), keys).withColumn("__parts", parts).withColumn("__own", own)
    cut = cut.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    cut = cut.select(*rows.columns, F.col("__own").cast("int").alias("own"), F.least("__own", other).cast("int").alias("lo"), F.greatest("__own", other).cast("int").alias("hi"))
    if attach is not None:
        cut = cut.join(attach.hint("merge"), member)
    return cut.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup sorted batches: tables of complete groups, and where each group starts (with the table's length at the end)."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b])
        first = starts(t)
        if first[-1]:
            yield t.slice(0, first[-1]), first
        held = t.slice(first[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.array([0, t.num_rows])


def prepare_workers(spark: SparkSession) -> None:
    """Ship the package, and hold Arrow batches that go to Python to some megabytes: a number of rows is no bound when rows are whole texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker function that gives memory back: workers are used again, and what they keep adds up over the stages of a job."""

    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # frees large buffers at once
        yield from run(batches)
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return lent


def map_texts(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[dict]], schema: str, *columns: str) -> DataFrame:
    """Run ``function`` over batches of the named columns in Arrow: it gets tuples of Arrow arrays and yields dicts of columns."""

    prepare_workers(df.sparkSession)
    wanted = _parse_datatype_string(schema)
    kinds = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function(tuple(b.columns) for b in batches):
            yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in kinds], schema=kinds)

    return df.select(*columns).mapInArrow(lean(run), wanted)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values.cast(kind) if values.type != kind else values
    return pa.array(values, kind)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """Texts as UTF-8 bytes, null as empty; only a few at a time become Python objects."""
    for k in range(0, len(column), SLICE):
        for v in column.slice(k, SLICE).cast(pa.binary()).to_pylist():
            yield v or b""


def texts(column: pa.Array) -> Iterator[str]:
    for k in range(0, len(column), SLICE):
        for v in column.slice(k, SLICE).to_pylist():
            yield v or ""
