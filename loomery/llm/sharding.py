"""Permutation-filled lookup table for shard placement.

Each shard walks its own permutation of the slots of a prime-sized table, given by an offset and a step drawn from its
name. Shards take turns, each claiming the next free slot it prefers, until the table is full: every shard holds an equal
share (within one slot a turn), and adding or removing a shard moves little else. The table is broadcast (its size is
fixed, whatever the data) and a row's place is one hash and one lookup.

Defined results: a null key hashes like any other value, so all such rows go to one shard; equal keys always go to one
shard; an empty table stays empty; extra columns are carried along, clashing ones keep their names and the new columns
take underscores in front. No text is looked at, so its length does not matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.shared import free_name, quoted

TABLE_SIZE = 65537
N_SHARDS = 256


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _draw(text: str, below: int) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") % below


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> list[int]:
    """For each slot the index of the shard that claimed it; a shard of weight w claims w slots at its turn."""
    if not is_prime(size):
        raise ValueError("the table size must be prime, so that every step visits every slot")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shard names must be distinct, at least one and at most as many as slots")
    turns = [max(1, w) for w in weights] if weights else [1] * len(shards)
    at = [_draw(f"offset:{name}", size) for name in shards]
    step = [1 + _draw(f"step:{name}", size - 1) if size > 2 else 1 for name in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            for _ in range(min(turns[i], left)):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                table[at[i]] = i
                left -= 1
    return table


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    rows = [(slot, shard, shards[shard]) for slot, shard in enumerate(lookup_table(shards, size, weights))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def place(df: DataFrame, key_col: str, shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    """df with slot, shard and shard_name added; one broadcast lookup a row and no shuffle."""
    slot, shard, name = (free_name(df, c) for c in ("slot", "shard", "shard_name"))
    own = free_name(df, "claimed_slot")
    table = table_frame(df.sparkSession, shards, size, weights).toDF(own, shard, name)
    return (
        df.withColumn(slot, F.pmod(F.xxhash64(F.col(quoted(key_col)).cast("string")), F.lit(size)).cast("int"))
        .join(F.broadcast(table), F.col(slot) == F.col(own))
        .drop(own)
    )


def shard_names(n: int = N_SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    return place(docs, "doc_id", shard_names()).select("doc_id", "source", "n_chars", "slot", "shard", "shard_name")
