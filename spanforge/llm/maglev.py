"""Shard placement by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table (offset and skip from its name's digest).
Shards take turns; at its turn a shard claims the first slot of its permutation that is still free, until the table
is full. A row's slot is its key's digest modulo the table size, so placement is one array lookup, and adding or losing a
shard moves few rows. A weight w gives a shard w turns a round.

Defined results: a null key is placed by the digest of the empty string; repeated rows land together; an empty table gives
an empty result; only the key is read, so other columns and their names don't matter; no shards is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, SHARDS = 65_537, 256


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """The shard index of each slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and be distinct")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("the number of slots must be a prime no smaller than the number of shards")
    offset = [_digest("o:" + n) % slots for n in names]
    skip = [_digest("s:" + n) % (slots - 1) + 1 for n in names]
    step = [0] * len(names)
    turns = [i for i, w in enumerate(weights or [1] * len(names)) for _ in range(w)]
    if not turns:
        raise ValueError("at least one shard must have a positive weight")
    table = np.full(slots, -1, np.int32)
    left = slots
    while left:
        for i in turns:
            while table[s := (offset[i] + step[i] * skip[i]) % slots] >= 0:
                step[i] += 1
            table[s] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 60 bits of the key's MD5 as a number, modulo the table size; made of built-ins only."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(df: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """(key, slot, shard). The table has one row a slot, whatever the input's size, and is broadcast; no row is moved."""
    names = names or shard_names()
    table = lookup_table(names, slots, weights)
    spark = df.sparkSession
    lut = spark.createDataFrame([(s, names[int(i)]) for s, i in enumerate(table)], "slot long, shard string")
    out = df.select(F.col(key).alias(key), slot_of(F.col(key), slots).alias("slot"))
    return out.join(F.broadcast(lut), "slot").select(key, "slot", "shard")
