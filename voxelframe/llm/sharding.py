"""Sharding (operator 4): a lookup table of prime size that shards fill by turns, each in its own order of preference.

Shards claim almost equal numbers of slots (in proportion to their weights), and
a change of the shard set moves few slots. The table has a fixed size, so it can
be broadcast, and a row finds its shard by one hash lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
TABLE_SIZE = 65_537  # prime, a thousand slots for each of 64 shards


def _number(text: str) -> int:
    """60 bits of MD5; the same in Python, Spark and SQL."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """Owner of each slot. A shard of weight w claims w slots per turn: the next free ones in its permutation of the slots."""
    if not is_prime(size):
        raise ValueError(f"the table size must be prime, got {size}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shard names must be distinct, at least one and no more than slots")
    turns = list(weights or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("weights must be one non-negative integer per shard, not all 0")
    step = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    spot = [_number(f"offset:{s}") % size for s in shards]
    owner, free = [-1] * size, size
    while free:
        for k, n in enumerate(turns):
            for _ in range(min(n, free)):
                while owner[spot[k]] >= 0:
                    spot[k] = (spot[k] + step[k]) % size
                owner[spot[k]] = k
                free -= 1
    return owner


def slot_of(column, size: int):
    """Slot of a key: 60 bits of the MD5 of its text, modulo the table size. A null key hashes as the empty text."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def shard_rows(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> DataFrame:
    """All columns of the input with ``shard_slot`` INT, ``shard_id`` INT and ``shard`` STRING.

    Narrow: a broadcast hash join with a table of exactly ``size`` rows. Equal
    keys, and so repeated rows, share a shard; null keys go where the empty text
    goes. Columns of these names in the input are replaced.
    """
    spark: SparkSession = df.sparkSession
    owner = fill_table(shards, size, weights)
    lookup = spark.createDataFrame([(i, k, shards[k]) for i, k in enumerate(owner)], "shard_slot int, shard_id int, shard string")
    return df.drop("shard_slot", "shard_id", "shard").withColumn("shard_slot", slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(lookup), "shard_slot")


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str], files_per_shard: int = 8, **kwargs) -> None:
    """One directory per shard, each written by ``files_per_shard`` tasks, so that a large shard is not one task's work."""
    placed = shard_rows(df, key, shards, **kwargs)
    salt = F.pmod(F.xxhash64(f"`{key}`"), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
