"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size: it starts at an offset and goes on
by a step, both drawn from its name.  The shards take turns; each claims the first slot of its order that is still
free, until the table is full.  So shards own equal parts (within one slot), and adding or removing one moves few
slots.  A row's key is hashed to a slot, and the table, whose size is the parameter ``size``, is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime of over 100 slots for each of 64 shards; keeps the parts within one percent of each other.
TABLE_SIZE = 8191
#: The largest table that is broadcast, in slots (12 bytes each).
LARGEST_TABLE = 1 << 20


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Owner of every slot, as the place of the shard in ``shards``."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need different names, and one at least")
    if not _prime(size) or size < len(shards) or size > LARGEST_TABLE:
        raise ValueError(f"the table needs a prime size from {len(shards)} to {LARGEST_TABLE}")
    at, step = [], []
    for name in shards:
        seed = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(seed[:8], "big") % size)
        step.append(int.from_bytes(seed[8:], "big") % (size - 1) + 1)
    owner, free = [-1] * size, size
    while free:
        for shard in range(len(shards)):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step[shard]) % size
            owner[slot], at[shard], free = shard, (slot + step[shard]) % size, free - 1
            if not free:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo ``size``; a null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size))


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard`` (place in ``shards``), in place of any that have these names.

    Equal keys, null ones included, go to the same shard.  Rows are neither moved nor dropped; an empty table stays
    empty.
    """
    table = lookup_table(shards, size)
    owners = df.sparkSession.createDataFrame(list(enumerate(table)), "slot bigint, shard int")
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key}`"), size))
    return keyed.join(F.broadcast(owners), "slot", "left")


def write_shards(df: DataFrame, path: str, key: str, shards: Sequence[str], files: int = 8,
                 size: int = TABLE_SIZE) -> None:
    """Write one folder for each shard, in at most ``files`` files each, dealt by a second hash of the key."""
    placed = place(df, key, shards, size).withColumn("_file", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(files)))
    placed.repartition(len(shards) * files, "shard", "_file").drop("_file", "slot") \
        .write.partitionBy("shard").parquet(path)
