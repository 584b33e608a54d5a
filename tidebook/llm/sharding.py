"""Placement of rows on shards by a permutation-filled lookup table, in DataFrame functions only.

Every shard has its own order of preference over the slots of a prime-sized table: it starts at an offset and goes on
by a step, both from a hash of its name, so that it meets every slot once. The shards take turns; each claims the first
slot in its order that is still free, until none is. A row's key is hashed to a slot, and the slot names the shard.
Adding or losing a shard moves few other rows, and no two shards differ by more than one slot.

The table has ``slots`` entries whatever the data, so broadcasting it is bounded by a parameter. Filling it is plain
control code on the driver; rows are placed by one broadcast join on the slot, with no shuffle.

Results: a null key counts as the empty text. Repeated rows go to one shard. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most slots of a table: it is broadcast.
MOST_SLOTS = 1_000_003


def _number(text: str) -> int:
    """The first 15 hex digits of the MD5 digest as an integer."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"at least one shard and a prime number of slots, no fewer than shards and at most {MOST_SLOTS}, are needed")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % slots
        owner[at[k]] = k
    return owner


def lookup(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """The table as rows (slot, shard), made by SQL functions from two literals."""
    owner = F.posexplode(F.split(F.lit(",".join(map(str, fill(shards, slots)))), ","))
    return spark.range(1).select(owner.alias("slot", "k")).select("slot", F.element_at(F.array(*map(F.lit, shards)), F.col("k").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of its MD5 digest modulo the size of the table."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; columns of these names in ``rows`` give way."""
    if not rows.columns:
        raise ValueError("rows has no columns")
    placed = rows.drop(*({"slot", "shard"} - {key})).withColumn("__slot", slot_of(F.col(f"`{key}`"), slots))
    table = lookup(rows.sparkSession, shards, slots).withColumnRenamed("slot", "__s")
    out = placed.join(F.broadcast(table), placed["__slot"] == table["__s"]).drop("__s")
    return out.withColumnRenamed("__slot", "slot")
