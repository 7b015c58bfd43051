"""Sharding by a permutation-filled lookup table.

Each shard has its own order of the slots of a prime-sized table, from two hashes of its name: an offset and a step.
The shards take turns, each claiming the first free slot in its order, until the table is full; shares differ by one
slot at most, and a new or lost shard moves few slots. A row's slot is a hash of its key modulo the table size; its
shard comes from a broadcast join with the table, whose size is the parameter.

Defined cases: a null key part counts as its own value and has a place like any other; rows of one key share a shard;
the output columns ``slot`` and ``shard`` replace columns of those names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
#: No larger table is broadcast.
MAX_SLOTS = 5_000_011


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot."""
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"the table size must be a prime of at most {MAX_SLOTS}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards need distinct names, one at least and no more than slots")
    number = lambda name, part: int(hashlib.md5(f"{part}:{name}".encode()).hexdigest()[:15], 16)
    at = [number(s, "offset") % slots for s in shards]
    steps = [number(s, "step") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + steps[shard]) % slots
            table[at[shard]] = shard
            free -= 1
            if not free:
                return table


def slot_of(keys: list[str], slots: int = SLOTS) -> Column:
    """A hash of the key columns, below ``slots``; it only uses functions that every SQL engine has."""
    parts = [F.coalesce(F.concat(F.lit("="), F.regexp_replace(F.col(k).cast("string"), "/", "//")), F.lit("/")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("long") % slots


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows: one array literal, folded by the optimizer, exploded in the engine."""
    table = ",".join(map(str, lookup_table(shards, slots)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    one = spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "index"))
    return one.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("index").cast("int") + 1).alias("shard"))


def assign(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with the ``slot`` and ``shard`` of its key; no rows are moved."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    rows = df.select(F.struct(*kept).alias("row") if kept else F.lit(None).alias("row"), slot_of(keys, slots).alias("slot"))
    found = rows.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot")
    return found.select(*(["row.*"] if kept else []), "slot", "shard")


def write_shards(df: DataFrame, path: str, keys: list[str], shards: list[str], slots: int = SLOTS, files_per_shard: int = 1) -> None:
    """A folder per shard. Rows are dealt by shard and a part of the slot, so that a shard may be several files."""
    rows = assign(df, keys, shards, slots)
    dealt = rows.repartition(len(shards) * files_per_shard, "shard", F.col("slot") % files_per_shard)
    dealt.drop("slot").write.partitionBy("shard").parquet(path)
