"""Masking of streams. Rules are stateless, so a stream is masked by the same expressions as a table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.integrity import apply_mapping, unique_mapping
from ..operators.masking import mask
from ..plans.policy import Policy


def mask_stream(stream: DataFrame, table: str, policy: Policy, **options: Any) -> DataFrame:
    """A masked stream; every source and sink of Structured Streaming can stand around it."""
    if not stream.isStreaming:
        raise ValueError("mask() is for tables")
    return mask(stream, table, policy, **options)


def write_masked(stream: DataFrame, table: str, policy: Policy, path: str, checkpoint: str, kind: str = "parquet", **options: Any) -> StreamingQuery:
    """A masked stream into files, exactly once, until all that is there is done."""
    out = mask_stream(stream, table, policy, **options)
    return out.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_sink(spark: SparkSession, column: str, salt: str, mapping_path: str, write: Callable[[DataFrame, int], None], min_int: int = 100000, max_int: int = 999999999) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch with collision-free numbers: each batch reads the mapping of those before it and adds to it.

    A batch that is run again finds its own additions and gives the same numbers.
    """

    def known() -> DataFrame | None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(mapping_path)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return spark.read.parquet(mapping_path).select("value", "token") if there else None

    def batch(df: DataFrame, number: int) -> None:
        before = known()
        mapping = unique_mapping(df, column, salt, min_int, max_int, before)
        new = mapping if before is None else mapping.join(before, "value", "left_anti")
        new.write.mode("append").parquet(mapping_path)
        write(apply_mapping(df, column, mapping), number)

    return batch
