"""Per-partition data reduction: each physical partition becomes one centroid (or k of them) and a row count."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.session import ship_package

KMEANS_ROUNDS = 100
CHUNK = 16_384  # rows that are assigned at a time


def kmeans_centers(data: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows spread by farthest-point seeding; deterministic."""
    if k == 1:
        return data.mean(axis=0, keepdims=True)
    rng = np.random.default_rng(seed)
    centers = [data[rng.integers(len(data))]]
    gap = np.full(len(data), np.inf)
    for _ in range(k - 1):
        gap = np.minimum(gap, ((data - centers[-1]) ** 2).sum(axis=1))
        centers.append(data[int(gap.argmax())])
    at = np.array(centers, dtype=float)
    for _ in range(KMEANS_ROUNDS):
        total, n = np.zeros_like(at), np.zeros(k)
        for lo in range(0, len(data), CHUNK):  # what a round needs besides the rows does not grow with them
            part = data[lo : lo + CHUNK]
            owner = ((part[:, None, :] - at[None]) ** 2).sum(axis=2).argmin(axis=1)
            np.add.at(total, owner, part)
            n += np.bincount(owner, minlength=k)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], at)
        if np.allclose(moved, at):
            break
        at = moved
    return at


class CollapseFunctions:
    """Reducers over an iterator of rows, for use with :func:`collapse_rdd_data`."""

    def mean(self, partition: Iterator) -> Iterator:
        """``(centroid, size)`` of the partition, ``(None, 0)`` if it is empty. Runs in constant memory."""
        total, n = None, 0
        for row in partition:
            v = np.asarray(list(row), dtype=float)
            total = v if total is None else total + v
            n += 1
        yield (None, 0) if n == 0 else (total / n, n)

    def kmeans(self, partition: Iterator, k: int = 1) -> Iterator:
        """``(k centroids, size)``; a partition of fewer than k rows gives ``([None], size)``."""
        rows = [list(row) for row in partition]
        if len(rows) < k or not rows:
            yield [None], len(rows)
        else:
            yield kmeans_centers(np.asarray(rows, dtype=float), k), len(rows)


def collapse_rdd_data(data, my_func: Callable, *args):
    """Apply ``my_func(partition, *args)`` to each physical partition of an RDD or DataFrame; returns an RDD of what it yields."""
    ship_package(SparkSession.active())
    rdd = data.rdd if isinstance(data, DataFrame) else data
    return rdd.mapPartitions(lambda part: my_func(part, *args))


def collapse_mean(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per physical partition, empty ones included: ``partition_id``, the mean of each column (null if empty), ``n``."""
    names = list(names)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(names)), 0
        for b in batches:
            if b.num_rows:
                total += [float(np.sum(c.to_numpy(zero_copy_only=False))) for c in b.columns]
                n += b.num_rows
        yield pa.RecordBatch.from_pydict({**{c: pa.array([total[k] / n if n else None], pa.float64()) for k, c in enumerate(names)}, "n": pa.array([n], pa.int64())})

    schema = ", ".join([f"`{c}` double" for c in names] + ["n long"])
    ship_package(df.sparkSession)
    out = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in names)).mapInArrow(reduce, schema)
    return out.select(F.spark_partition_id().alias("partition_id"), *names, "n")


def collapse_kmeans(df: DataFrame, names: Sequence[str], k: int = 1) -> DataFrame:
    """k centroids per physical partition as rows ``(partition_id, cluster, <names>, n)``; partitions of fewer than k rows give none."""
    names = list(names)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
        rows = np.concatenate(parts) if parts else np.empty((0, len(names)))
        centers = kmeans_centers(rows, k) if len(rows) >= k and len(rows) else np.empty((0, len(names)))
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(range(len(centers)), pa.int32()), **{c: pa.array(centers[:, j], pa.float64()) for j, c in enumerate(names)}, "n": pa.array([len(rows)] * len(centers), pa.int64())}
        )

    schema = ", ".join(["cluster int"] + [f"`{c}` double" for c in names] + ["n long"])
    ship_package(df.sparkSession)
    out = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in names)).mapInArrow(reduce, schema)
    return out.select(F.spark_partition_id().alias("partition_id"), "cluster", *names, "n")
