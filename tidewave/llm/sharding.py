"""Sharding by jump consistent hashing: key and shard count decide the shard, without a ring table.

When shards are appended, a row either stays or goes to one of the new shards; the expected share
that moves is the least possible. Law ``key``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gapless, written


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: the last jump of its own random walk that stays below ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    at = np.full(len(state), -1, np.int64)
    jump = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = jump[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        stretch = float(1 << 31) / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[moving] = np.floor((at[moving] + 1) * stretch).astype(np.int64)
        moving = moving[jump[moving] < shards]
    return at


def jump_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard now and with one more shard, and its gapless slot within the shard.

    Columns: the key, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (unsigned; null
    text: 0), law, shard, slot, grown_shard. A null key counts as -1; equal keys share a shard and get
    slots of their own; an empty table gives no rows; other columns are not read.
    """

    @F.pandas_udf("shard int, grown_shard int")
    def placed(keys: pd.Series) -> pd.DataFrame:
        values = keys.to_numpy(np.int64)
        return pd.DataFrame({"shard": jump_hash(values, shards).astype(np.int32), "grown_shard": jump_hash(values, shards + 1).astype(np.int32)})

    content = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    ).withColumn("place", placed(F.coalesce("key", F.lit(-1).cast("long"))))
    rows = written(rows.select("key", "size", "text_crc32", "place.shard", "place.grown_shard"), "shards")
    out = gapless(rows, ["shard"], ["key", "size", "text_crc32"], "slot", rows.count())
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
