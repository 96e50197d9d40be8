"""Connected components of a link table, by rounds of minimum-label contraction. No link ever reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import bounded, drop_saved, lean, prepare_workers, saved

MAX_ROUNDS = 60  # each round removes every node that is not the least among its neighbours


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links reduced to one star per component, its centre the least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook the larger root below the smaller, then shorten all paths
        u, v = root[left], root[right]
        if not (differ := u != v).any():
            break
        np.minimum.at(root, np.maximum(u, v)[differ], np.minimum(u, v)[differ])
        while not np.array_equal(up := root[root], root):
            root = up
    out = root != np.arange(len(nodes))
    return nodes[root[out]], nodes[out]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, so that memory stays bounded."""
    for b in batches:
        x, y = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def components(links: DataFrame, contracted: bool = False) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)`` of LONGs; the component is its least node.

    Each round finds the least neighbour of every node, renames all ends of
    links by it and drops those that became loops; the renamings are composed
    backwards at the end. A hub is aggregated before the shuffle.

    Links that come out of a Python worker, reduced by :func:`forest`, are
    ``contracted`` already: a second worker in the same task would double the
    workers of an executor, and they stay and share the tasks of all later stages.
    """
    spark = links.sparkSession
    prepare_workers(spark)
    first = links.where("a <> b")
    left = saved(first if contracted else first.mapInArrow(lean(_contract), "a long, b long"), "links")
    steps: list[DataFrame] = []
    sizes: list[int] = []
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        step = saved(least.select("node", F.least("node", "m").alias("up")), "step")
        sizes.append(step.count())
        hinted = bounded(step, sizes[-1])
        to_a, to_b = hinted.select(F.col("node").alias("a"), F.col("up").alias("ua")), hinted.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        renamed = left.join(to_a, "a").join(to_b, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")).where("a <> b")
        following = saved(renamed.distinct().mapInArrow(lean(_contract), "a long, b long"), "links")
        drop_saved(left)
        left = following
        steps.append(step)
    else:
        raise RuntimeError(f"links did not contract within {MAX_ROUNDS} rounds")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))  # empty
    out = steps[-1].select("node", F.col("up").alias("component"))
    for step, size in zip(reversed(steps[:-1]), reversed(sizes[1:]), strict=True):  # `out` has the rows of the step after
        out = step.join(bounded(out.select(F.col("node").alias("up"), "component"), size), "up", "left").select("node", F.coalesce("component", "up").alias("component"))
    return out
