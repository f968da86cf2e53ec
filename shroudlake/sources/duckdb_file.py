"""Tables of a DuckDB file on a file system that the driver and the executors share, by way of Parquet."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.masking import mask
from ..plans.policy import Policy


def _name(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


def _connect(path: str, read_only: bool):  # noqa: ANN202  (the package is optional)
    import duckdb

    return duckdb.connect(path, read_only=read_only)


def duckdb_tables(path: str) -> list[str]:
    with _connect(path, True) as con:
        return [r[0] for r in con.execute("SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE' ORDER BY 1").fetchall()]


def read_duckdb(spark: SparkSession, path: str, table: str, folder: str) -> DataFrame:
    """A table, exported to Parquet below folder; it isn't loaded into the driver."""
    target = str(Path(folder) / f"{table}-in")
    with _connect(path, True) as con:
        con.execute(f"COPY {_name(table)} TO '{target}' (FORMAT parquet, PER_THREAD_OUTPUT true)")
    return spark.read.parquet(target)


def mask_duckdb(spark: SparkSession, path: str, table: str, policy: Policy, folder: str) -> None:
    """Replaces a table by its masked copy, in one transaction."""
    target = str(Path(folder) / f"{table}-out")
    mask(read_duckdb(spark, path, table, folder), table, policy).write.parquet(target)
    with _connect(path, False) as con:
        con.execute("BEGIN")
        con.execute(f"CREATE OR REPLACE TABLE {_name(table)} AS SELECT * FROM read_parquet('{target}/*.parquet')")
        con.execute("COMMIT")
