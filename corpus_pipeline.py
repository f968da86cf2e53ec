"""A training corpus from raw documents: rules, near-duplicates, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table; the next stage reads it back from Parquet. Mixing writes
its table in the order of the queue, and the token files keep that order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudlake.llm.common import cut, discard, scratch_path, small
from shroudlake.llm.decontam import contamination
from shroudlake.llm.mixing import fair_queue
from shroudlake.llm.neardup import near_duplicates
from shroudlake.llm.queries import small_batches, tokenizer_path
from shroudlake.llm.rules import apply_policy, ledger
from shroudlake.llm.tokens import token_ids

#: Token ids can't be computed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None

#: Per cent of an item's windows that are a leak of it.
LEAK_SHARE = 50


def _row_key(*columns: str) -> Column:
    """A name for rows with equal columns, never null."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256).substr(1, 32)


def _one_of_each(docs: DataFrame, key: Column) -> DataFrame:
    """docs with one row for each key, the same in every run; only rows whose key repeats are shuffled whole."""
    keyed = docs.withColumn("_key", key)
    again = cut(keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    if again.isEmpty():
        return docs
    again = small(again)
    row = F.struct(*docs.columns)
    once = keyed.join(again, "_key", "left_anti").select(*docs.columns)
    first = keyed.join(again, "_key", "left_semi").groupBy("_key").agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("_row"))
    return once.unionByName(first.select("_row.*"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; every rule is measured once for each."""
    small_batches(spark)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])  # so that no column has the name of a measure
    name = dict(zip(docs.columns, plain.columns, strict=True))
    kept = apply_policy(ledger(plain, name["doc_id"], name["text"], carry=tuple(plain.columns))).where("kept")
    return kept.select(*[F.col(name[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Where one id has several texts, each stays or goes by the verdict on itself. Repeated rows of one document are one;
    a row without id isn't linked and stays.
    """
    small_batches(spark)
    keyed = docs.withColumn("_key", _row_key("doc_id", "text"))
    dropped = cut(near_duplicates(keyed, words=5, percent=80, carry=("_key",)).where(~F.col("kept")).select("_key").distinct())
    kept = keyed.join(small(dropped), "_key", "left_anti").select(*docs.columns)
    return _one_of_each(kept, _row_key("doc_id", "text"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the operator's verdict (two items) and hold no item of eight words or more
    by half of its windows at least: one such item is a leak already, while a chance window or a short item isn't."""
    keyed = docs.withColumn("_key", _row_key("doc_id", "text"))
    found = contamination(keyed.select("_key", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_key", share=LEAK_SHARE)
    leaked = cut(found.where("contaminated OR n_most > 0").select("_key").distinct())
    return keyed.join(small(leaked), "_key", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its queue; equal rows are one document with
    the copies of all of them."""
    key = _row_key("doc_id", "source", "text")
    _, queue = fair_queue(docs.select(key.alias("_key"), "text", "source"), key="_key")
    rows = _one_of_each(docs, key).withColumn("_key", key).join(queue.select("_key", F.col("position").alias("_position")), "_key")
    return rows.repartitionByRange("_position").sortWithinPartitions("_position").select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """The documents' token ids, written as compressed shards and read back: a row for each copy of a document.

    Documents that were read from files keep the order in which they stand there, others are in that of doc_id. The files
    stay at path, else in a new folder below the shared one; part and shard say where a document is.
    """
    small_batches(spark)
    try:
        docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        order = ["_file", "_at"]
    except AnalysisException:  # not from files
        order = None
    return token_ids(docs, tokenizer_path(), path=path, order=order).select("doc_id", "part", "shard", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token ids", token_output)]


def run(spark: SparkSession, sf_dir: str, tokens: str | None = None) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's table goes when the next one's is written.

    tokens: where the token files go (see token_output).
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir, path=tokens)  # it has written its files when it returns
    discard(spark, last)
    return out
