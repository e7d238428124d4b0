"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table. Shards take
turns; in its turn a shard claims the first slot of its order that is still free. The
table depends on the shard names and the size alone, so it is bounded by a parameter
and is broadcast; a row's slot is a hash of its key, its shard one look-up away. When a
shard leaves, few rows of other shards move.

Defined cases: a null key takes the slot of the empty string; equal keys share a shard;
an empty table gives an empty result; columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table; a prime.
TABLE_SIZE = 65537
SHARDS = 64
MAX_SLOTS = 1 << 22


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names")
    if size > MAX_SLOTS or size < len(names) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table needs a prime number of slots, no fewer than shards and at most {MAX_SLOTS}")
    at = [_number(f"{n}/offset") % size for n in names]
    step = [_number(f"{n}/step") % (size - 1) + 1 for n in names]
    table, left = [-1] * size, size
    while True:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of its MD5, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(size)


def lookup(spark: SparkSession, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows (slot, shard); `size` of them, four bytes a slot in the plan."""
    packed = bytearray(b"".join(x.to_bytes(4, "big") for x in fill(names, size)))
    shard = F.conv(F.hex(F.substring(F.lit(packed), (F.col("id") * 4 + 1).cast("int"), F.lit(4))), 16, 10)
    return spark.range(size).select(F.col("id").alias("slot"), shard.cast("int").alias("shard"))


def place(docs: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """docs with columns slot and shard (0 up to the number of shards)."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    own = [c for c in docs.columns if c not in ("slot", "shard")]
    table = F.broadcast(lookup(docs.sparkSession, names, size))
    return docs.select(*own, slot_of(F.col(key), size).alias("slot")).join(table, "slot", "left").select(*own, "slot", "shard")


def place_sql(key: str = "doc_id", shards: int = SHARDS, size: int = TABLE_SIZE) -> tuple[str, str]:
    """DuckDB expressions for the slot of a key and for the shard of a column `slot`."""
    packed = "".join(f"{x:03d}" for x in fill([f"shard-{i:05d}" for i in range(shards)], size))
    slot = f"(('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15))::BIGINT % {size})"
    return slot, f"CAST(substr('{packed}', CAST(slot AS INTEGER) * 3 + 1, 3) AS INTEGER)"
