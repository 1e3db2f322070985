"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table: offset, offset + skip, ... modulo the
size. Shards take turns, each claiming its first slot that is still free, until the table is full; so shares differ by at
most one slot, and a change of the shard list moves few slots. A row's place is the shard of the slot of its key's hash:
one lookup, in a table whose size is fixed beforehand and that is therefore safe to broadcast.

Cases: a null key hashes like the text "null-key" and so has one place; equal keys share a place; an empty table gives an
empty result; extra columns are kept, but columns named like the slot and the shard are replaced; shard names must be distinct and not empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537


def preference(shard: str, slots: int) -> tuple[int, int]:
    """(offset, skip) of a shard's order of preference."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of each slot. slots is prime and at least the number of shards."""
    if not shards or len(set(shards)) < len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    order = [preference(s, slots) for s in shards]
    table, turn = np.full(slots, -1, np.int32), [0] * len(shards)
    left = slots
    while True:
        for k, (offset, skip) in enumerate(order):
            at = (offset + turn[k] * skip) % slots
            while table[at] >= 0:
                turn[k] += 1
                at = (offset + turn[k] * skip) % slots
            table[at] = k
            turn[k] += 1
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 15 hex digits of its MD5 as a number, modulo the slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null-key")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, *, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row. The broadcast table has `slots` rows, whatever the data."""
    spark: SparkSession = df.sparkSession
    table = lookup_table(shards, slots)
    import pandas as pd

    lookup = spark.createDataFrame(pd.DataFrame({slot_name: np.arange(slots, dtype=np.int64), shard_name: np.array(shards, object)[table]}), f"`{slot_name}` long, `{shard_name}` string")
    slot = slot_of(F.col(key), slots)
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot_name.lower(), shard_name.lower())]
    return df.select(*others, slot.alias(slot_name)).join(F.broadcast(lookup), slot_name)
