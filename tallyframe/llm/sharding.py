"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def name_hash(name: str, salt: str, buckets: int) -> int:
    """The first 15 hex digits of the md5 of salt:name, modulo buckets."""
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16) % buckets


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """For each slot the index of its shard.

    Each shard prefers slots in the order offset, offset + skip, ... modulo the prime number of
    slots, which meets each once. Shards take turns, each claiming the first free slot of its
    order, until none is free: shares differ by one at most, and taking a shard away moves few
    slots between the others.
    """
    if not is_prime(slots) or not shards or len(shards) > slots or len(set(shards)) != len(shards):
        raise ValueError("slots must be prime, and shards distinct, one at least and not more than slots")
    at = [name_hash(s, "offset", slots) for s in shards]
    skip = [1 + name_hash(s, "skip", slots - 1) if slots > 2 else 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def assign_shards(df: DataFrame, shards: list[str], slots: int = 65_537, key: str = "doc_id") -> DataFrame:
    """The rows of df with slot (long) and shard (string); such columns of df are replaced.

    The key's slot comes from its md5; a null key counts as the empty string. Equal keys go to one shard.
    The table has as many rows as slots, whatever the data: that bound is what lets it be
    broadcast. Placement is then one hash and one look-up a row; nothing of df is shuffled.
    """
    spark = df.sparkSession
    owner = lookup_table(shards, slots)
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    # one literal string instead of so many rows keeps the plan small
    filled = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("slot_", "owner_"))
    filled = filled.select(F.col("slot_").cast("long").alias("slot"), F.get(names, F.col("owner_").cast("int")).alias("shard"))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    slot = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)
    out = df.drop("slot", "shard").withColumn("slot", slot)
    return out.join(F.broadcast(filled), "slot").select(*out.columns, "shard")
