"""Exact repartitioning: a row goes to the physical partition its label names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelframe.options import check_positive

BROADCAST_LABELS = 100_000  # most labels that are broadcast; each becomes a partition, so a real job has far fewer


def repartitionByCol(df: DataFrame, colname: str, preLabeled: bool, numPartitions: int = -1) -> DataFrame:
    """One shuffle that sends each row to partition ``label``; schema and rows unchanged, no sort.

    ``preLabeled``: the column is an INT or LONG that already holds ids from 0;
    ``numPartitions`` then defaults to the largest id plus one, so gaps are
    empty partitions. Otherwise any type will do: distinct values are numbered
    in sorted order (null, if present, comes first).
    """
    if numPartitions != -1:
        check_positive(numPartitions)
    if preLabeled:
        if not isinstance(df.schema[colname].dataType, (T.IntegerType, T.LongType)):
            raise AssertionError(f"{colname} must be an Int or Long column when preLabeled is true")
        if numPartitions == -1:
            top = df.agg(F.max(colname)).first()[0]
            numPartitions = 1 if top is None else int(top) + 1
        return df.repartitionById(check_positive(numPartitions), F.col(colname).cast("int"))

    labels = df.select(F.col(colname).alias("__value")).distinct()
    count = labels.count()
    if numPartitions == -1:
        numPartitions = max(1, count)
    ids = _numbered(labels, count)
    joined = df.join(F.broadcast(ids) if count <= BROADCAST_LABELS else ids, F.col(colname).eqNullSafe(F.col("__value")), "left")
    return joined.repartitionById(numPartitions, F.col("__id")).select(*(df[c] for c in df.columns))


def _numbered(labels: DataFrame, count: int) -> DataFrame:
    """``(__value, __id)``: distinct values numbered from 0 in sorted order, null first, by a distributed sort."""
    in_order = labels.orderBy(F.col("__value").asc_nulls_first())
    schema = T.StructType([*labels.schema.fields, T.StructField("__id", T.IntegerType())])
    if count <= BROADCAST_LABELS:  # a bounded table
        return labels.sparkSession.createDataFrame([(r[0], k) for k, r in enumerate(in_order.collect())], schema)
    return in_order.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF(schema)


def repartition_as(df: DataFrame, mode: str, numPartitions: int, label: str = "partition_id") -> DataFrame:
    """A labelled table dealt out in one of the ways to compare: ``col`` (exact), ``range``, ``order``, ``rep`` (by hash) or ``col-no`` (exact, labels counted first)."""
    ways = {
        "col": lambda: repartitionByCol(df, label, True, numPartitions),
        "range": lambda: df.repartitionByRange(numPartitions, label),
        "order": lambda: df.orderBy(label),
        "rep": lambda: df.repartition(numPartitions, label),
        "col-no": lambda: repartitionByCol(df, label, False),
    }
    if mode not in ways:
        raise AssertionError(f"Mode not understood! You must choose between: {', '.join(ways)} (got {mode!r})")
    return ways[mode]()


repartition_by_col = repartitionByCol
