"""Placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an offset and a skip from
its name's hash. Shards take turns; at its turn a shard claims the first free slot by its preference.
So shards differ by one slot at most, and a shard that leaves moves few slots of the others. A key's
slot is its hash modulo the table's size, and the table, of ``size`` rows whatever the data, is broadcast.

Filling the table is one loop over ``size`` slots on the driver; placement uses DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST = 1 << 20


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = 65_537) -> list[int]:
    """For each slot, the index of its shard. size: a prime, not below the number of shards."""
    if size > LARGEST or size < max(2, len(shards)) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size must be a prime from {max(2, len(shards))} to {LARGEST}")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, and differently")
    at = [_hash(f"offset:{s}") % size for s in shards]
    skip = [_hash(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """The key's slot; null keys read as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % size


def table_frame(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """The table as rows (slot, shard), made from two literals."""
    filled = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(filled).alias("slot", "at"))
    return rows.select(F.col("slot").cast("long"), F.element_at(names, F.col("at").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], size: int = 65_537) -> DataFrame:
    """df with slot and shard; every row is placed, repeated keys alike. Input columns of these names are replaced."""
    own = [c for c in df.columns if c not in ("slot", "shard") or c == key]
    rows = df.select(*own, slot_of(F.col(key), size).alias("_slot"))
    table = table_frame(df.sparkSession, shards, size).withColumnsRenamed({"slot": "_at", "shard": "_shard"})
    placed = rows.join(F.broadcast(table), F.col("_slot") == F.col("_at"))
    return placed.select(*[c for c in own if c not in ("slot", "shard")], F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))
