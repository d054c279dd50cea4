"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a prime-sized table, each in its own preference order (an offset and a step from a hash
of its name, so every order visits every slot). The table has ``slots`` rows whatever the input, so it is broadcast; a
document's slot is the first 60 bits of the MD5 of its key modulo the table's size, and the join gives its shard: no shuffle, no
state, and few documents move when a shard joins or leaves.

Edge cases: null keys hash like an empty string and so stay together; equal keys share a shard; an empty table gives an empty result;
the result's own columns (slot, shard) replace columns of the input with these names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 65537


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that holds each slot. slots must be prime and no smaller than the number of shards."""
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct names, one at least, and no more than the slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not prime")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digest]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digest]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + step[k]) % slots
            table[slot], at[k], left = k, (slot + step[k]) % slots, left - 1
            if not left:
                return np.array(table, dtype=np.int32)


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    table = fill_table(shards, slots)
    return spark.createDataFrame([(k, shards[v]) for k, v in enumerate(table.tolist())], "slot int, shard string")


def assign_shards(docs: DataFrame, shards: Sequence[str] | int = SHARDS, slots: int = SLOTS, key_col: str = "doc_id") -> DataFrame:
    """docs with slot and shard."""
    shards = shard_names(shards) if isinstance(shards, int) else list(shards)
    side = F.broadcast(lookup(docs.sparkSession, shards, slots))  # slots rows, at every size of docs
    slot = F.conv(F.substring(F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots
    placed = docs.select(*[c for c in docs.columns if c.lower() not in ("slot", "shard")], slot.cast("int").alias("slot"))
    return placed.join(side, "slot").select(*placed.columns, "shard")


def op7(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))


def op7_sql() -> str:
    """The table stands in the SQL as a letter for each slot, since filling it takes turns; the tests hold it against a plain filling."""
    letters = "".join(chr(0x100 + k) for k in fill_table(shard_names(SHARDS)))
    return f"""
WITH d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INT) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(unicode(substr('{letters}', slot + 1, 1)) - 256 AS VARCHAR), 5, '0') AS shard FROM d
"""
