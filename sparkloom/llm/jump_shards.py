"""Sharding by jump consistent hashing: stable keys to shards without a ring table.

Appending a shard moves only the rows that the new shard takes. The law is
``key``: the key and the number of shards decide, nothing else.

Defined results. A null key is hashed as the fixed text "null key", so it has a stable shard. Null
text counts as empty: size 1, CRC-32 0. Repeated rows each get their own slot. An
empty table gives an empty result. Other columns of the input are left out, so
clashing names do no harm. Text length does not matter: only digests are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import spread, text_or_empty, written

#: The multiplier of the published jump hash.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys at once."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state, at, ahead = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * STEP + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((at[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key, shards: int):
    """Column: shard of an integer or string key. Keys are mixed first, as ids are often in sequence."""

    @F.pandas_udf(T.IntegerType())
    def pick(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(jump(x.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return pick(F.when(key.isNull(), F.xxhash64(F.lit("null key"))).otherwise(F.xxhash64(key)))


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", block_rows: int = 50_000) -> DataFrame:
    """Shard, size and gapless slot of every row.

    Slots are numbered in two steps, so that a shard, which grows with the data, is
    never one task's work: rows go to blocks of about ``block_rows`` within their
    shard by a hash, blocks get offsets from their counts, and rows are numbered
    inside their block. Counts are one row a block; the offsets come from them alone.
    """
    body = text_or_empty(text)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"),
    )
    rows = written(rows, "shards")
    blocks = spread(rows.count(), block_rows * shards)
    spot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(7)), F.lit(blocks))
    # Repeats of one row share that hash; their blocks are told apart by where they were read.
    rows = rows.withColumn("block", F.when(F.lit(blocks) > 1, F.pmod(spot + F.spark_partition_id(), F.lit(blocks))).otherwise(F.lit(0)).cast("long"))
    rows = written(rows, "blocks")
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(before.drop("n"), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.coalesce("before", F.lit(0)) + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """The rows themselves, one folder a shard, several files where a shard is large."""
    docs.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)
