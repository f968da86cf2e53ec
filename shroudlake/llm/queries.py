"""The registered queries of this subpackage, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import contamination
from .mixing import mix
from .neardup import near_duplicates
from .quality import score_quality
from .quotes import as_mail, link_quotes
from .rules import ablation, apply_policy, ledger
from .sharding import shard
from .sql import SQL
from .tokens import token_ids
from .toxicity import score_toxicity
from .warc import resolve_revisits

SHARDS = 24


#: Rows of a batch of texts between Spark and Python in the registered queries, where the session has Spark's default of 10,000.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches to Python that stay small in this session: operators leave sessions as they are, these queries are programs of their own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"), shards=SHARDS, appended=1)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_hamming_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def op4_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl of the pages: each is fetched in full once, and asked for again under another spelling of its address.

    The second answer is a 304; some come with another entity tag, some with a date alone or with neither, and some
    are from before the full response.
    """
    k, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    date = F.concat(F.lit("day "), F.pmod(k, F.lit(28)).cast("string"))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    bare = lambda **x: F.map_filter(F.create_map(*[y for name, v in x.items() for y in (F.lit(name.replace("_", "-")), v)]), lambda _, v: v.isNotNull())
    full = pages.select((k * 2).alias("record_id"), "url", (k * 10).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"), bare(content_length=size, content_type=F.lit("text/html"), etag=tag, last_modified=date, cache_control=F.lit("max-age=60")).alias("headers"))
    again_tag = F.when(k % 5 == 0, F.lit('"other"')).when(k % 5 < 4, F.concat(F.lit("W/"), tag))
    again_date = F.when(k % 3 > 0, date)
    again = pages.select(
        (k * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "https://www."), F.lit("#again")).alias("url"), (k * 10 + F.when(k % 7 == 3, -5).otherwise(5)).alias("ts"), F.lit("revisit").alias("kind"), again_tag.alias("etag"), again_date.alias("last_modified"),
        bare(content_length=F.lit("0"), etag=again_tag, date=F.lit("day 30"), cache_control=F.lit("max-age=120"), server=F.lit("edge")).alias("headers"),
    )
    return full.union(again)


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(read(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("record_id", "canonical_url", "ts", "kind", "refers_to", "status", F.array_join(pairs, ";").alias("headers"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(read(spark, sf_dir, "documents")))


def op7_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_quotes(as_mail(read(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"), F.col("n_levels").cast("long").alias("n_levels"), F.col("n_quotes").cast("long").alias("n_quotes"), "n_linked", "parent", "root", "depth", "place")


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_jump_sharding, op2_quadratic_quality, op3_hamming_neardup, op4_prefix_decontamination, op5_revisit_resolution, op6_rule_ledger, op7_fair_mixing, op8_repair_tokens, op9_quotation_links, op10_toxicity_chain, rule_ablation)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
