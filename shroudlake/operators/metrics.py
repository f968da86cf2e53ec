"""Privacy metrics: k-anonymity, l-diversity and the risk of re-identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quasi(df: DataFrame, columns: list[str]) -> list[Column]:
    """The quasi-identifiers; a column that the table lacks counts as an empty text."""
    have = {c.lower(): c for c in df.columns}
    return [F.col(have[c.lower()]).alias(f"_q{i}") if c.lower() in have else F.lit("").alias(f"_q{i}") for i, c in enumerate(columns)]


def classes(df: DataFrame, quasi_identifiers: list[str], sensitive: str | None = None) -> DataFrame:
    """Equivalence classes: _q0, _q1, ..., size and diversity (distinct sensitive values that aren't null).

    Values are counted by class first, so a class of any size is spread over tasks before its counts meet.
    """
    keys = [f"_q{i}" for i in range(len(quasi_identifiers))]
    if sensitive is None:
        return df.select(*_quasi(df, quasi_identifiers)).groupBy(*keys).agg(F.count("*").alias("size"), F.lit(None).cast("long").alias("diversity"))
    values = df.select(*_quasi(df, quasi_identifiers), F.col(sensitive).alias("_s")).groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    return values.groupBy(*keys).agg(F.sum("_n").alias("size"), F.count("_s").alias("diversity"))


def evaluate(df: DataFrame, quasi_identifiers: list[str], sensitive: str | None = None, threshold_k: int = 5, threshold_l: int = 2) -> DataFrame:
    """One row: total_records, num_classes, k_anonymity, avg_class_size, records_at_risk and their percentage,
    max_risk, avg_risk, l_diversity, classes_without_sensitive and compliant.

    An empty table has k 0 and is compliant. l-diversity is null without an attribute; classes whose sensitive values are all
    null don't count for it, and it is 0 if there are no others.
    """
    size, n = F.col("size"), F.coalesce(F.sum("size"), F.lit(0))
    k = F.coalesce(F.min("size"), F.lit(0))
    risky = F.coalesce(F.sum(F.when(size < threshold_k, size)), F.lit(0))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    diversity = F.coalesce(F.min(F.when(F.col("diversity") > 0, F.col("diversity"))), F.lit(0)) if sensitive else F.lit(None).cast("long")
    out = classes(df, quasi_identifiers, sensitive).agg(
        n.alias("total_records"), F.count("*").alias("num_classes"), k.alias("k_anonymity"), per(n, F.count("*")).alias("avg_class_size"), risky.alias("records_at_risk"), (per(risky, n) * 100).alias("risk_pct"),
        per(F.lit(1.0), k).alias("max_risk"), per(F.count("*"), n).alias("avg_risk"), diversity.alias("l_diversity"), F.count(F.when(F.col("diversity") == 0, 1)).alias("classes_without_sensitive"),
    )
    good = F.col("k_anonymity") >= threshold_k
    if sensitive:
        good = good & (F.col("l_diversity") >= threshold_l)
    return out.withColumn("compliant", (F.col("total_records") == 0) | good)


def l_distribution(df: DataFrame, quasi_identifiers: list[str], sensitive: str) -> DataFrame:
    """(l, num_classes): how many classes have so many distinct sensitive values."""
    return classes(df, quasi_identifiers, sensitive).where("diversity > 0").groupBy(F.col("diversity").alias("l")).agg(F.count("*").alias("num_classes"))
