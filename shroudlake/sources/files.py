"""CSV, TSV, JSON, JSON Lines, Parquet and text, by suffix or by name."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".orc": "orc", ".sql": "sql"}


def format_of(path: str) -> str:
    """The format that a path's suffix names; text for others."""
    return FORMATS.get(PurePosixPath(path.rstrip("/")).suffix.lower(), "text")


def table_of(path: str) -> str:
    """The table that a file is named after."""
    return PurePosixPath(path.rstrip("/")).name.split(".")[0]


def read_table(spark: SparkSession, path: str, kind: str | None = None, delimiter: str | None = None, schema: str | None = None) -> DataFrame:
    """A file or folder as a table.

    CSV and TSV need a header; all their columns are text, and an empty cell is an empty text, not null. A malformed
    line of JSON Lines is an error. A JSON document may be an array or one object. Other files give lines of text in
    one column, `line`.
    """
    kind = kind or format_of(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        sep = delimiter or ("\t" if kind == "tsv" else ",")
        df = reader.csv(path, header=True, inferSchema=False, sep=sep, multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue="")
        return df.na.fill("")
    if kind == "jsonl":
        return reader.json(path, mode="FAILFAST")
    if kind == "json":
        return reader.json(path, multiLine=True, mode="FAILFAST")
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    if kind == "text":
        return spark.read.text(path).withColumnRenamed("value", "line")
    raise ValueError(f"no table in {kind} files")


def write_table(df: DataFrame, path: str, kind: str | None = None, delimiter: str | None = None, mode: str = "error") -> None:
    """A table as a folder of files; an empty one keeps its schema where the format has one."""
    kind = kind or format_of(path)
    writer = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        writer.csv(path, header=True, sep=delimiter or ("\t" if kind == "tsv" else ","), quote='"', escape='"', lineSep="\n", emptyValue="")
    elif kind in ("json", "jsonl"):
        writer.json(path, ignoreNullFields=False)
    elif kind in ("parquet", "orc"):
        writer.format(kind).save(path)
    else:
        raise ValueError(f"tables aren't written to {kind} files")


def dry_run(df: DataFrame) -> None:
    """Computes everything and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
