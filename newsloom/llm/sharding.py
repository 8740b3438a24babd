"""Placement of rows on shards through a lookup table of prime size.

Every shard has an order of preference over all slots of the table. The shards take turns; at its turn a shard
claims the first slot of its order that is still free, until the table is full. Shards get equal shares but for one
slot, and a shard that comes or goes moves few slots of the others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Slots of the production table; a prime, and the bound of what is broadcast.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the index of its shard in ``shards``. Raises on no shard, doubled names or no prime size."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given, each once")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, not below that of the shards")
    digest = [hashlib.md5(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digest]
    table, tried, filled = [-1] * slots, [0] * len(shards), 0
    while True:
        for s in range(len(shards)):
            slot = (offset[s] + tried[s] * skip[s]) % slots
            while table[slot] >= 0:
                tried[s] += 1
                slot = (offset[s] + tried[s] * skip[s]) % slots
            table[slot] = s
            tried[s] += 1
            filled += 1
            if filled == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: its MD5 as text, the first 15 hex digits, modulo the table's size. Null counts as the empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """All columns of ``docs`` with ``slot`` and ``shard`` (an earlier column of either name is replaced).

    Equal keys (repeated rows, nulls) get the same shard. The table has exactly ``slots`` rows, so its broadcast has a
    fixed size; the rows are neither shuffled nor sorted.
    """
    spark = SparkSession.getActiveSession() or docs.sparkSession
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], "_slot int, _shard string")
    rest = [c for c in docs.columns if c not in ("slot", "shard")]
    placed = docs.withColumn("_slot", slot_of(docs[key_col], slots)).join(F.broadcast(table), "_slot")
    return placed.select(*rest, F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))
