"""Shard placement by a permutation-filled lookup table.

The table has a prime number of slots. Every shard visits all slots in an order
of its own (offset + i * skip modulo the prime), and the shards take turns
claiming their next free slot. A row's shard is the table's entry at its key's
hash modulo the prime: one array access, whatever the number of shards. Adding
or removing a shard moves about one key in N and few others.

The table's size is a parameter and does not grow with the rows, so it is
broadcast (about 20 bytes a slot) and joined by slot, inside the JVM.

Defined results: a null key hashes as the empty string and so has a shard;
repeated keys share a shard; an empty table gives an empty result; columns
named ``slot`` or ``shard`` in the input are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
MOST_SLOTS = 16_777_259  # the bound of what is broadcast: about 320 MB


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """(offset, skip) of a shard's order over the slots."""
    d = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> np.ndarray:
    """The shard's index at every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, once each")
    if not _is_prime(slots) or slots < len(shards) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime from {len(shards)} to {MOST_SLOTS}")
    order = sorted(range(len(shards)), key=lambda i: shards[i])  # the caller's order of names does not matter
    table = np.full(slots, -1, np.int32)
    at, skip = (np.array(x, np.int64) for x in zip(*(preference(s, slots) for s in shards), strict=True))
    filled = 0
    while True:
        for i in order:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            filled += 1
            if filled == slots:
                return table


def key_slot(key: Column, slots: int = SLOTS) -> Column:
    """The first 60 bits of the key's MD5, modulo the number of slots."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % F.lit(slots)


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (string)."""
    table = lookup_table(shards, slots)
    import pandas as pd

    rows = df.sparkSession.createDataFrame(pd.DataFrame({"slot": np.arange(slots, dtype=np.int64), "shard": np.array(shards, object)[table]}), "slot long, shard string")
    keyed = df.drop("slot", "shard") if key not in ("slot", "shard") else df.withColumnRenamed(key, "_key").drop("slot", "shard")
    column = F.col(key) if key not in ("slot", "shard") else F.col("_key")
    # An inner join would also do: every slot has a row.
    return keyed.withColumn("slot", key_slot(column, slots)).join(F.broadcast(rows), "slot", "left").select(*keyed.columns, "slot", "shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(docs.select("doc_id", "source"))


QUERIES = {"op2_sharding": op2_sharding}
# The table as two digits a slot: DuckDB reads a document's shard from its slot's place in the text.
_TABLE = "".join(f"{i:02d}" for i in lookup_table())
ORACLE = {
    "op2_sharding": f"""
WITH d AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, source, slot, 'shard-0' || substr('{_TABLE}', (2 * slot + 1)::BIGINT, 2) AS shard FROM d"""
}
