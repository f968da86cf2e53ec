"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash60, numbered, running


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key among n, by Lamping and Veach's jump consistent hash."""
    key = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = ahead[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((shard[live] + 1).astype(np.float64) * step).astype(np.int64)
        live = live[ahead[live] < n]
    return shard


def jump_column(key: Column, n: int) -> Column:
    """The shard, 0 to n - 1, of a long key column that is already well mixed."""
    if n < 1:
        raise ValueError("there must be a shard at least")

    @F.pandas_udf("int")
    def shard_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump(keys.to_numpy(np.int64), n), dtype="int32")

    return shard_of(key)


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, appended: int = 1) -> DataFrame:
    """Puts every row into a shard by its key, and numbers the rows of each shard.

    Returns the key, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot and grown_shard, the shard
    once `appended` more exist: a row either keeps its shard or goes into a new one. slot runs from 0 without gaps
    in each shard, in the order of a hash of the key: a shard read by slot is shuffled.

    A null key counts as the empty text and has one shard; a null text has size 8 and checksum 0. Rows with equal
    keys share a shard and follow each other by checksum and size; equal rows have slots of their own, and however many
    rows have one key, they are numbered by many tasks. An empty table gives an empty result. Other columns of df are
    left out, so their names can't clash.
    """
    blob = F.col(text).cast("binary")
    rows = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(blob), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(blob), F.lit(0)).cast("long").alias("text_crc32"),
        hash60(key).alias("_hash"),
    )
    rows = numbered(rows.withColumn("shard", jump_column(F.col("_hash"), shards)).withColumn("grown_shard", jump_column(F.col("_hash"), shards + appended)))
    out = running(rows, ["shard"], ["_hash", "text_crc32", "size", "_row"], {"slot": F.lit(1)})
    return out.select(key, "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
