"""Consistent sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table (an offset and a step taken
from a hash of its name). The shards take turns; each claims the first slot of its permutation that is
still free, until the table is full. A key belongs to the shard that owns slot ``hash(key) mod size``.
Shares differ by at most one slot, and when a shard leaves or joins, few keys of other shards move.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard that claimed it. ``size`` is a prime above the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _is_prime(size) or size <= len(shards):
        raise ValueError("the table size must be a prime above the number of shards")
    place, step = [], []
    for name in shards:
        digest = blake2b(name.encode(), digest_size=16).digest()
        place.append(int.from_bytes(digest[:8], "little") % size)
        step.append(int.from_bytes(digest[8:], "little") % (size - 1) + 1)
    owner = [-1] * size
    free = size
    while True:
        for shard in range(len(shards)):
            while owner[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % size
            owner[place[shard]] = shard
            free -= 1
            if not free:
                return owner


def slot_of(*key: Column | str, size: int = TABLE_SIZE) -> Column:
    """The slot of a key; a null part of a key hashes like an absent one, so it has a slot too."""
    return F.pmod(F.xxhash64(*key), F.lit(size)).cast("long")


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Rows of ``key`` with ``slot`` and ``shard``; one row for each input row.

    The table has ``size`` rows whatever the data, so it is broadcast and a row finds its shard by one
    hash probe, without a shuffle. Null keys share one slot; repeated keys get the same shard; other
    columns of ``df`` are left out, so their names cannot clash; a key that is itself called slot or shard is
    handed on as ``key``; no rows give no rows.
    """
    owner = lookup_table(shards, size)
    table = df.sparkSession.createDataFrame([(slot, shards[shard]) for slot, shard in enumerate(owner)], "slot long, shard string")
    name = "key" if key.lower() in ("slot", "shard") else key
    keyed = df.select(F.col(f"`{key}`").alias(name), slot_of(F.col(f"`{key}`"), size=size).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(F.col(f"`{name}`"), "slot", "shard")
