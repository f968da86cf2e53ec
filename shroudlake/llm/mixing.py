"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, hash60, numbered, running, small

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The largest number of times that a document is taken.
EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The target of each source: budget shared by weight, at most `epochs` times the source's size.

    sizes has one row for each source (source, source_size); the result adds source_rank (by code
    point, null last), weight and target. The budget is the sum of all sizes. What a source can't take is shared again
    by weight among the others until none is above its limit: with sources in the order of limit over weight, those
    before some place take their limit, and the first place where the level no longer passes the limit ends the search.
    Sources are ranked and summed by ranges, so there may be as many as there are hosts.
    """
    ranked = running(sizes, [], [F.col("source").asc_nulls_last()], {"_n": F.lit(1)})
    rank = (F.col("_n") + 1).cast("int").alias("source_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_n"), F.lit(len(weights))).cast("int") + 1)
    limit = (epochs * F.col("source_size")).cast("double")
    ranked = ranked.select("source", "source_size", rank, weight.alias("weight"), limit.alias("_limit"), (limit / weight).alias("_ratio"))
    budget, total = ranked.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    if budget is None:
        return ranked.select("source", "source_size", "source_rank", "weight", F.col("_limit").alias("target"))
    found = running(ranked, [], ["_ratio", "source_rank"], {"_full": F.col("_limit"), "_gone": F.col("weight")})
    level = (F.lit(budget) - F.col("_full")) / (F.lit(total) - F.col("_gone"))
    best = found.where(F.col("_ratio") >= level).agg(F.min(F.struct("_ratio", "source_rank", level.alias("level"))).alias("m")).first().m
    target = F.col("_limit")
    if best is not None:
        open_ = F.struct("_ratio", "source_rank") >= F.struct(F.lit(best[0]).alias("_ratio"), F.lit(best[1]).alias("source_rank"))
        target = F.when(open_, F.least(F.col("weight") * best.level, F.col("_limit"))).otherwise(F.col("_limit"))
    return found.select("source", "source_size", "source_rank", "weight", target.alias("target"))


def fair_queue(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, queue): see mix() for the documents, which here also have a row number of their own, _row.

    queue has a row for each copy that is taken: _row, the key, finish, source_rank, size and position, the number of
    words before it. Copies of all sources are sorted globally by finish time, by ranges, and the order is cut
    where the budget ends.
    """
    first = list(dict.fromkeys([key, *carry]))
    base = numbered(
        df.select(
            *first,
            F.col(source).cast("string").alias("_source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
            hash60(F.lit(seed), key).alias("_hash"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).alias("_crc"),
        )
    )
    sources = cut(targets(cut(base.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))), weights, epochs))
    joined = base.join(small(sources), F.col("_source").eqNullSafe(F.col("source"))).drop("source", "_source")
    placed = cut(running(joined, ["source_rank"], ["_hash", "_size", "_crc", "_row"], {"_before": F.col("_size")}))
    served = F.col("_epoch") * F.col("source_size") + F.col("_before") + F.col("_size")
    there = placed.where((F.col("_size") > 0) & (F.col("target") > 0))
    copies = there.select("_row", key, "source_rank", "source_size", "_before", "_size", "target", F.explode(F.array(*[F.lit(e) for e in range(epochs)])).alias("_epoch"))
    copies = copies.select("_row", key, "source_rank", F.col("_size").alias("size"), (served.cast("double") / F.col("target")).alias("finish"))
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    queue = running(copies, [], ["finish", "source_rank", "_row"], {"position": F.col("size")})
    queue = cut(queue.where(F.col("position") + F.col("size") <= budget))
    taken = queue.groupBy("_row").agg(F.count("*").alias("_n"), F.min("finish").alias("finish"), F.min("position").alias("position"))
    n = F.coalesce("_n", F.lit(0))
    documents = placed.join(taken, "_row", "left").select("_row", *first, F.col("_size").alias("size"), "source_size", "target", (n * F.col("_size")).cast("long").alias("taken"), n.cast("int").alias("copies"), "finish", "position", "source_rank")
    return documents, queue


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often each document is taken when sources are mixed to their weights.

    Documents of a source are shuffled by a hash of seed and key. A copy's virtual finish time is the source's
    cumulative words up to and with it, divided by the source's target; copies of all sources are ordered by
    it, and the order is cut where the total budget (all words) ends. A document is taken whole, `epochs` times at most.

    Returns the key, size (words), source_size, target, taken (words, repeats counted), copies, finish and position (of
    the first copy in the mix; null if none is taken) and source_rank, plus the columns in `carry`. A null text has no
    words; null is a source of its own, after the others. Documents without words are never taken. Rows with equal keys
    follow each other by size and checksum; equal rows are placed one after the other. An empty table gives an empty
    result. A source whose first document is longer than its target may get nothing. Reruns give the same result.
    """
    return fair_queue(df, key, text, source, seed, weights, epochs, carry)[0].drop("_row")
