"""Previews of a policy, and the difference between two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policy import Policy, normal
from .masking import mask


def _unpivot(pairs: DataFrame, columns: list[str]) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    cells = [F.struct(F.lit(c).alias("column"), text(f"_a{i}").alias("left"), text(f"_b{i}").alias("right")) for i, c in enumerate(columns)]
    return pairs.select(*[c for c in pairs.columns if c.startswith("_key")], F.inline(F.array(*cells)))


def _pairs(df: DataFrame, table: str, left: Policy | None, right: Policy, columns: list[str], key: list[str]) -> DataFrame:
    """Each row with its columns under two policies side by side. Masking is a projection, so no join is needed."""
    both = df.select("*", *[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)], F.struct(*df.columns).alias("_row"))
    for side, policy in (("_a", left), ("_b", right)):
        made = both.select(*df.columns, *[c for c in both.columns if c not in df.columns])
        masked = mask(made, table, policy) if policy is not None else made
        both = masked.select("_row.*", *[c for c in made.columns if c not in df.columns], *[F.col(c).alias(f"{side}{i}") for i, c in enumerate(columns)])
    return both.drop("_row")


def _touched(df: DataFrame, table: str, *policies: Policy | None) -> list[str]:
    rules = {normal(c) for p in policies if p and (t := p.table(table)) for c in t.columns} | {c for p in policies if p for _, cols in p.composites(table) for c in cols}
    return [c for c in df.columns if normal(c) in rules]


def preview(df: DataFrame, table: str, policy: Policy, rows: int = 5, key: list[str] | None = None) -> DataFrame:
    """(key.., column, before, after, changed) of the first rows by key."""
    key = key or [df.columns[0]]
    out = cells(df.orderBy(*key).limit(rows), table, None, policy, key)
    return out.select(*[f"_key{i}" for i in range(len(key))], "column", F.col("left").alias("before"), F.col("right").alias("after"), "changed")


def cells(df: DataFrame, table: str, left: Policy | None, right: Policy, key: list[str]) -> DataFrame:
    """(_key0.., column, left, right, changed) for each cell that a policy has a rule for; null policy: as it is."""
    columns = _touched(df, table, left, right)
    paired = _pairs(df, table, left, right, columns, key)
    if not columns:
        return paired.select(*[f"_key{i}" for i in range(len(key))], F.lit("").alias("column"), F.lit("").alias("left"), F.lit("").alias("right"), F.lit(False).alias("changed")).where(F.lit(False))
    return _unpivot(paired, columns).withColumn("changed", ~F.col("left").eqNullSafe(F.col("right")))


def policy_diff(df: DataFrame, table: str, left: Policy, right: Policy, key: list[str] | None = None) -> DataFrame:
    """(column, rows, n_changed, n_identical, status) of two policies over a whole table."""
    out = cells(df, table, left, right, key or [df.columns[0]])
    counts = out.groupBy("column").agg(F.count("*").alias("rows"), F.count_if("changed").alias("n_changed"))
    return counts.select("column", "rows", "n_changed", (F.col("rows") - F.col("n_changed")).alias("n_identical"), F.when(F.col("n_changed") > 0, "CHANGED").otherwise("IDENTICAL").alias("status"))
