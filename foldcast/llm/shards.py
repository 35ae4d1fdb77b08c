"""Shards by jump consistent hashing: a stable key and the number of shards decide, and nothing is stored.

Defined results: a NULL key hashes as the empty text, NULL texts have size 1 and crc32 0, repeated rows get a slot each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from foldcast.llm.shared import need_columns, stored

_STEP, _UNIT = np.uint64(2862933555777941757), float(1 << 31)  # fixed values of the published hash


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; with one shard more, a key stays or moves to the new one."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = ahead[moving]
        state[moving] = state[moving] * _STEP + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = np.floor((shard[moving] + 1) * (_UNIT / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return run(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, size, text_crc32, shard, slot in the shard by key, and shard after one more is appended.

    Slots come from a range partitioning by shard and key: counts of each range give its first slot, so no task sees a whole
    shard, and rows of one repeated key are spread by their place in the input.
    """
    need_columns(docs, key, text)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            F.col(key).alias("_key"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            shard_of(F.col(key), shards).alias("shard"),
            shard_of(F.col(key), shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "sharded",
    )
    order = ["shard", "_key", "text_crc32", "size", "_at"]
    placed = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "shard-ranges")
    counts = placed.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_range").orderBy(*order[1:])
    ranked = placed.withColumn("_rank", F.row_number().over(inside)).join(first, ["shard", "_range"])
    return ranked.select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard"
    )
