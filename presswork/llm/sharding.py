"""Placement of documents on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import md5_number, table

SLOTS = 65537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard (its place in the list) of each slot.

    Each shard prefers the slots in an order of its own, offset + i * skip modulo the prime number of slots.
    The shards take turns to claim the first slot of their order that is still free, so all get the same
    number within one, and a shard that comes or goes moves few slots beyond its own.
    """
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    at = [_number(f"offset/{s}") % slots for s in shards]
    skip = [_number(f"skip/{s}") % (slots - 1) + 1 for s in shards]
    owner, filled = [-1] * slots, 0
    while filled < slots:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            filled += 1
            if filled == slots:
                break
    return np.array(owner, np.int32)


def with_shards(docs: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """All columns of the rows, and their slot and shard (name), which take the place of columns of these names.

    The slot is a hash of the key as text, so equal keys go together and null keys go where the empty text
    goes. The lookup table has `slots` rows whatever the data, which bounds what is broadcast; no row moves.
    """
    owner = fill_table(shards, slots)
    lookup = docs.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot long, shard string")
    slot = md5_number(F.coalesce(F.col(key_col).cast("string"), F.lit("")), 15) % slots
    columns = [c for c in docs.columns if c not in ("slot", "shard")]
    return docs.select(*columns, slot.alias("slot")).join(F.broadcast(lookup), "slot").select(*columns, "slot", "shard")


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Each row's key_col, its slot and its shard (name); see with_shards."""
    return with_shards(docs.select(key_col), shards, key_col, slots)


def write_shards(docs: DataFrame, shards: list[str], path: str, key_col: str = "doc_id", slots: int = SLOTS) -> None:
    """Writes all columns of the rows as Parquet, a folder (shard=...) for each shard."""
    with_shards(docs, shards, key_col, slots).drop("slot").write.partitionBy("shard").parquet(path)


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of each document, for 64 shards."""
    return place(table(spark, sf_dir, "documents"), shard_names(64))


def sharding_sql(n: int, slots: int = SLOTS) -> str:
    """The placement over the finished table, which is part of the text."""
    owner = ",".join(map(str, fill_table(shard_names(n), slots).tolist()))
    slot = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots}"
    return f"WITH t AS MATERIALIZED (SELECT unnest(range({slots})) AS slot, unnest([{owner}]) AS owner) SELECT doc_id, d.slot, 'shard-' || lpad(owner::VARCHAR, 5, '0') AS shard FROM (SELECT doc_id, {slot} AS slot FROM documents) d JOIN t ON t.slot = d.slot"
