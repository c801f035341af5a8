"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table, and the shards take
turns claiming their next free slot, until none is left. Shards get equal shares to within one slot,
and when one comes or goes few slots change hands. Placing a key is one hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precolens.llm.common import free_name

# A prime, well over a hundred times the number of shards.
SLOTS = 4099
_HEX = 15  # digits of the digest that a long holds


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_HEX], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The place in ``shards`` of each slot's owner. Names must differ; order of turns is that of names."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("give at least one shard, each once")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, and no less than that of shards")
    turns = sorted(range(len(shards)), key=lambda s: shards[s])
    # offset, offset + skip, offset + 2 skip, ... visits each slot of a prime table once.
    spot = [_number(f"offset {name}") % slots for name in shards]
    skip = [_number(f"skip {name}") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    owner, free = [-1] * slots, slots
    while True:
        for s in turns:
            while owner[spot[s]] >= 0:
                spot[s] = (spot[s] + skip[s]) % slots
            owner[spot[s]] = s
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key's text; null goes with the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("long"), F.lit(slots))


def table_rows(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the lookup table, one row for each slot."""
    owner = lookup_table(shards, slots)
    names = F.split(F.lit("\n".join(shards)), "\n")
    places = F.split(F.lit(" ".join(map(str, owner))), " ")
    return spark.range(1).select(F.posexplode(places).alias("slot", "at")).select(
        F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("at").cast("int") + 1).alias("shard")
    )


def place(rows: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with their slot and shard, by the text of column ``key_col``.

    Nothing is shuffled, so a key that many rows share costs nothing; all of them get one shard, as do
    null and empty keys together. Names of the two columns are lengthened if ``rows`` has them. The
    broadcast table has ``slots`` rows, whatever the input.
    """
    slot = free_name(rows, "slot")
    shard = free_name(rows, "shard")
    table = table_rows(rows.sparkSession, shards, slots).toDF(slot, shard)
    return rows.withColumn(slot, slot_of(F.col(key_col), slots)).join(F.broadcast(table), slot).select(
        *(F.col(c) for c in rows.columns), slot, shard
    )


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One folder for each shard; a shard with many rows is split among tasks and files."""
    placed.hint("rebalance", shard_col).write.partitionBy(shard_col).parquet(path)
