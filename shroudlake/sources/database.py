"""Tables of databases over JDBC: partitioned reads with filters pushed down, writes to staging tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import ForeignKey
from ..operators.masking import mask
from ..plans.policy import Policy, normal

#: What names of production systems look like. Which addresses are refused depends on them.
_PRODUCTION = re.compile(r"\bprod\b|production|\blive\b|\bmaster\b|main[-_]?db|rds\.amazonaws\.com|database\.windows\.net|gcp\.cloudsql", re.I)


def is_production(url: str) -> bool:
    """Whether the host or database of an address looks like a production system."""
    if not isinstance(url, str) or "://" not in url:
        return False
    parts = urlsplit(url.removeprefix("jdbc:"))
    return bool(_PRODUCTION.search(parts.hostname or "") or _PRODUCTION.search(parts.path.lstrip("/")))


def redact(url: str) -> str:
    """An address without its password; other texts are as they were."""
    return re.sub(r"^((?:jdbc:)?[A-Za-z][\w+.-]*://[^/@:]*):[^/]*@", r"\1:***@", url) if isinstance(url, str) else url


def read_jdbc(spark: SparkSession, url: str, table: str, where: str | None = None, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table; with a numeric key it is read in ranges of the key, whose bounds the database gives."""

    def start() -> DataFrameReader:
        return spark.read.format("jdbc").option("url", url).options(**options)

    reader = start()
    if key:
        low, high = start().option("query", f"SELECT min({key}) AS a, max({key}) AS z FROM {table}").load().first()
        if low is not None:
            reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
    df = reader.option("dbtable", table).load()
    return df.where(F.expr(where)) if where else df


def changed_rows(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of after in which a cell differs from the row of the same key in before."""
    if not key:
        raise ValueError("a table is updated in place by its primary key, so it needs one")
    old = before.select(*key, F.struct(*[c for c in before.columns if c not in key]).alias("_old"))
    new = F.struct(*[c for c in after.columns if c not in key])
    return after.join(old, key).where(~F.to_json(F.col("_old")).eqNullSafe(F.to_json(new))).drop("_old")


def write_staging(df: DataFrame, url: str, table: str, allow_production: bool = False, **options: str) -> None:
    """Masked rows into a staging table, which the database then merges in one transaction of its own."""
    if is_production(url) and not allow_production:
        raise PermissionError(f"{redact(url)} looks like a production system")
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("overwrite").save()


@contextmanager
def _connection(spark: SparkSession, url: str) -> Iterator[Any]:
    """A connection of the driver's JVM, for catalogs and statements; data go through Spark."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        yield connection
    finally:
        connection.close()


def _rows(result: Any, *columns: str) -> list[tuple[str, ...]]:
    out = []
    while result.next():
        out.append(tuple(result.getString(c) for c in columns))
    return out


def tables_of(spark: SparkSession, url: str) -> list[str]:
    """The tables of a database."""
    with _connection(spark, url) as c:
        kinds = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.String, 1)
        kinds[0] = "TABLE"
        return sorted(r[0] for r in _rows(c.getMetaData().getTables(None, None, "%", kinds), "TABLE_NAME"))


def primary_key(spark: SparkSession, url: str, table: str) -> list[str]:
    """The columns of a table's primary key, in order."""
    with _connection(spark, url) as c:
        found = _rows(c.getMetaData().getPrimaryKeys(None, None, table), "KEY_SEQ", "COLUMN_NAME")
    return [name for _, name in sorted(found, key=lambda r: int(r[0]))]


def imported_keys(spark: SparkSession, url: str, table: str) -> list[ForeignKey]:
    """The foreign keys of a table, from the database's catalog."""
    with _connection(spark, url) as c:
        found = _rows(c.getMetaData().getImportedKeys(None, None, table), "FK_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME")
    names = dict.fromkeys(r[0] for r in found)
    groups = [sorted((r for r in found if r[0] == n), key=lambda r: int(r[1])) for n in names]
    return [ForeignKey(normal(table), tuple(normal(r[2]) for r in g), normal(g[0][3]), tuple(normal(r[4]) for r in g)) for g in groups]


def mask_in_place(spark: SparkSession, url: str, table: str, policy: Policy, staging: str | None = None, allow_production: bool = False, **options: str) -> int:
    """Masks a table of a database: changed rows go to a staging table, from which one transaction updates them by primary key.

    The rule's where_clause limits the rows. Returns how many rows changed.
    """
    if is_production(url) and not allow_production:
        raise PermissionError(f"{redact(url)} looks like a production system")
    key = primary_key(spark, url, table)
    rule = policy.table(table)
    before = read_jdbc(spark, url, table, rule.where_clause if rule else None)
    rows = changed_rows(before, mask(before, table, policy, type_policy="preserve"), key)
    staging = staging or f"{table}_MASKED"
    write_staging(rows, url, staging, allow_production, **options)
    named = {normal(c) for c in (rule.columns if rule else {})} | {c for _, cols in policy.composites(table) for c in cols}
    changed = [c for c in before.columns if normal(c) in named and c not in key]
    with _connection(spark, url) as c:
        quote = c.getMetaData().getIdentifierQuoteString().strip()
        q = lambda name: f"{quote}{name}{quote}"
        same = " AND ".join(f"s.{q(k)} = {q(table)}.{q(k)}" for k in key)
        c.setAutoCommit(False)
        try:
            statement = c.createStatement()
            sets = ", ".join(f"{q(x)} = (SELECT s.{q(x)} FROM {q(staging)} s WHERE {same})" for x in changed)
            n = statement.executeUpdate(f"UPDATE {q(table)} SET {sets} WHERE EXISTS (SELECT 1 FROM {q(staging)} s WHERE {same})") if changed else 0
            statement.executeUpdate(f"DROP TABLE {q(staging)}")
            c.commit()
        except Exception:
            c.rollback()
            raise
    return n
