"""Connected components of links that never leave the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, discard, scratch_path

#: Rounds after which something must be wrong: each at least halves the depth of every tree.
MOST_ROUNDS = 60
#: Links that a task joins in memory at once.
CHUNK = 1 << 18


def _stars(edges: DataFrame) -> DataFrame:
    """Links (u, v), u > v, with the components of edges and no more rows: in each task, chunks of links become stars around
    their smallest nodes. Only for whole numbers, else edges as they are."""
    kind = edges.schema["u"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}
        held, of = 0, None

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        def out() -> pa.RecordBatch:
            leaves = [x for x, y in above.items() if x != y]
            return pa.RecordBatch.from_arrays([pa.array(leaves, of), pa.array([root(x) for x in leaves], of)], names=["u", "v"])

        for batch in batches:
            of = batch.column(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = root(above.setdefault(u, u)), root(above.setdefault(v, v))
                if u != v:
                    above[max(u, v)] = min(u, v)
            held += batch.num_rows
            if held >= CHUNK:
                yield out()
                above.clear()
                held = 0
        if above:
            yield out()

    return edges.mapInArrow(run, f"u {kind}, v {kind}")


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of links, and that of nodes that keep them from being the answer: those under two nodes, or over and under one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("_u"), F.lit(0).alias("_v")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("n").agg(F.sum("_u").alias("_u"), F.max("_v").alias("_v"))
    return ends.agg(F.coalesce(F.sum("_u"), F.lit(0)), F.count_if(F.col("_u") + F.col("_v") > 1)).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of a link, the smallest node that it reaches.

    Alternates large stars (each node points its larger neighbours at the smallest one) and small stars (the same
    for smaller neighbours) until every node hangs on one that hangs on none. Before and between, tasks join the links that
    they hold, which ends small inputs at once: a round is many jobs, and each takes memory of the driver. A hub is an aggregation with partial sums and a join with the table of
    smallest neighbours: a broadcast if there are few links, else a stored table, so that Spark can split the hub. Links to
    itself and with nulls count for nothing; repeated ones count once; without links the result is empty.
    """
    spark, stored = links.sparkSession, []

    def table(df: DataFrame, n_links: int) -> DataFrame:
        if 2 * n_links <= common.BROADCAST_ROWS:  # it has no more rows than links have ends
            return F.broadcast(df)
        stored.append(scratch_path(spark, "smallest"))
        df.write.parquet(stored[-1])
        return spark.read.parquet(stored[-1])

    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    edges = cut(_stars(edges.distinct()))
    for _ in range(MOST_ROUNDS):
        n_links, unsettled = _state(edges)
        if not unsettled:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(table(least, n_links), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(table(least, n_links), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(_stars(small.union(least.select("u", F.col("m").alias("v"))).distinct()))
        while stored:
            discard(spark, stored.pop())
    else:
        raise RuntimeError("components don't settle")
    roots = edges.select(F.col("v").alias("u"), "v")
    return edges.union(roots).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
