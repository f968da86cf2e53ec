"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables (default sf0.1). BENCH_CPUS: threads (default 8). Every query is run once to warm up, then timed
over a full write to nowhere; rows_per_s is for the masking of orders with seven rules.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudlake import registered
from shroudlake.operators.masking import mask
from shroudlake.registered import policy


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table over all cores: here a file is often one row group, which costly expressions would keep on one core."""
    df, n = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


registered.read = read


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with derived contact columns under seven rules: hash, mail mask, name, pattern, jitter, date shift, hex hash."""
    key = F.col("o_orderkey").cast("string")
    df = read(spark, sf_dir, "orders").withColumns({"email": F.concat(F.lit("user"), key, F.lit("@example.org")), "full_name": F.concat(F.lit("Name "), key), "ssn": F.concat(F.lit("123-45-"), F.lpad(key, 4, "0")), "token": F.md5(key.cast("binary"))})
    rules = {"o_orderkey": "hash", "email": "email_mask", "full_name": ("faker", {"provider": "name"}), "ssn": ("pattern_mask", {"keep_last": 4}), "o_totalprice": ("jitter", {"percentage": 10}), "o_orderdate": "date_shift", "token": ("hash", {"length": 32})}
    return mask(df, "orders", policy("orders", **rules))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines with hashed keys, rounded prices and truncated dates."""
    rules = {"l_orderkey": "hash", "l_partkey": "hash", "l_extendedprice": ("round_to", {"step": 100}), "l_shipdate": ("date_truncate", {"level": "month"}), "l_returnflag": ("choice", {"choices": ["A", "N", "R"]})}
    return mask(read(spark, sf_dir, "lineitem"), "lineitem", policy("lineitem", **rules))


NAMES = ["fk_consistency", "hash_int_customer", "composite_lineitem", "fpe_digits_orders", "fpe_card_derived", "text_redact_documents", "text_redact_checked_documents", "json_mask_events", "k_anonymity_customer", "l_diversity_part", "reid_risk_lineitem", "subset_customer_cascade", "scan_customer", "policy_diff_customer"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {"mask_orders_7_rules": wide, "mask_lineitem_5_rules": lines} | {n: registered.QUERIES[n] for n in NAMES}
    try:
        from shroudlake.llm.queries import QUERIES

        queries |= QUERIES
    except ImportError:
        pass
    took, failed = {}, {}
    for name, f in queries.items():
        try:
            for _ in range(2):
                start = time.perf_counter()
                f(spark, sf_dir).write.format("noop").mode("overwrite").save()
                took[name] = round(time.perf_counter() - start, 3)
                if took[name] > 20:
                    break
        except Exception as e:  # the other queries still count
            failed[name] = str(e)[:200]
            took.pop(name, None)
    rows = {t: read(spark, sf_dir, t).count() for t in ("orders", "lineitem")}
    speed = {n: round(rows[t] / took[n]) for n, t in (("mask_orders_7_rules", "orders"), ("mask_lineitem_5_rules", "lineitem")) if n in took}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "rows_per_s": speed, "failed": failed}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
