"""SQL dumps: PostgreSQL COPY and INSERT statements of all dialects, read as tables, masked and written again.

A dump is split into pieces in one pass: text that isn't data, heads of data statements, rows, and ends. Cells keep
their literals, so what no rule changes is written as it was. A statement with data for a table with rules that
can't be read is an error: nothing slips through unmasked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.masking import mask
from ..plans.policy import Policy, normal
from ..shared import discard, scratch_path

_NAME = r"(?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])"
_TABLE = rf"{_NAME}(?:\s*\.\s*{_NAME})*"
_COPY = re.compile(rf"\s*COPY\s+({_TABLE})\s*(?:\(([^)]*)\))?\s*FROM\s+STDIN\b([^;]*);[^\n]*(?:\n|$)", re.I)
_INSERT = re.compile(rf"\s*(?:INSERT\s+(?:\w+\s+)*?INTO|REPLACE\s+INTO)\s+({_TABLE})\s*(?:\(([^()]*)\))?\s*(?:OVERRIDING\s+\w+\s+VALUE\s*)?VALUES\s*", re.I)
_DATA = re.compile(r"\s*(?:INSERT\b|REPLACE\s+INTO\b|COPY\b[^;]*\bSTDIN\b)", re.I)
_DOLLAR = re.compile(r"\$(\w*)\$")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0", "Z": "\x1a", "v": "\v"}


@dataclass
class Piece:
    """A part of a dump. kind: other, head, row or end; values are None for NULL; tail follows the row."""

    kind: str
    text: str = ""
    statement: int = 0
    row: int = 0
    form: str = ""
    table: str = ""
    columns: list[str] = field(default_factory=list)
    values: list[str | None] = field(default_factory=list)
    literals: list[str] = field(default_factory=list)
    tail: str = ""


def unescape(text: str) -> str:
    """Backslash escapes decoded, in one pass."""
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text, flags=re.DOTALL)


def _end_of_quoted(text: str, at: int) -> int:
    """The place behind a quoted text that starts at `at`: '..', "..", `..` with doubled quotes and backslashes, or $tag$..$tag$."""
    if text[at] == "$":
        tag = _DOLLAR.match(text, at)
        end = text.find(tag[0], tag.end()) if tag else -1
        return end + len(tag[0]) if tag and end >= 0 else at + 1 if not tag else len(text)
    quote, i = text[at], at + 1
    while i < len(text):
        if text[i] == "\\" and quote == "'":
            i += 2
        elif text[i] == quote:
            if text[i + 1 : i + 2] != quote:
                return i + 1
            i += 2
        else:
            i += 1
    return len(text)


def _skip(text: str, at: int) -> int:
    """The place behind what can't be cut at `at`: a quoted text, a comment, or one character."""
    c = text[at]
    if c in "'\"`" or c == "$" and _DOLLAR.match(text, at):
        return _end_of_quoted(text, at)
    if text.startswith("--", at):
        end = text.find("\n", at)
        return len(text) if end < 0 else end
    if text.startswith("/*", at):
        end = text.find("*/", at)
        return len(text) if end < 0 else end + 2
    return at + 1


def literal_value(literal: str) -> str | None:
    """The value of a literal as text; None for NULL."""
    text = literal.strip()
    if text.upper() == "NULL":
        return None
    if m := re.match(r"(?:[NEnebBxX]|_\w+\s*)?'", text):
        return unescape(text[m.end() : -1].replace("''", "'"))
    if m := _DOLLAR.match(text):
        return text[m.end() : -len(m[0])]
    return text


def format_literal(value: str | None, like: str, number: bool) -> str:
    """A masked value as a literal, in the manner of the one it replaces."""
    if value is None:
        return "NULL"
    if number or re.fullmatch(r"TRUE|FALSE", value, re.I) and "'" not in like:
        return value
    prefix = "N" if like.strip()[:2] in ("N'", "n'") else ""
    return prefix + "'" + value.replace("\\", "\\\\").replace("'", "''") + "'"


def _tuple(text: str, at: int) -> tuple[list[str], int]:
    """The literals of a parenthesised list that starts at `at`, and the place behind it."""
    out, depth, start, i = [], 1, at + 1, at + 1
    while i < len(text):
        c = text[i]
        if c == "(":
            depth, i = depth + 1, i + 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return [*out, text[start:i].strip()], i + 1
            i += 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i = i + 1
        else:
            i = _skip(text, i)
    raise ValueError("a list of values doesn't end")


def _statement_end(text: str, at: int) -> int:
    while at < len(text) and text[at] != ";":
        at = _skip(text, at)
    return min(len(text), at + 1)


_CELL = re.compile(r'("(?:[^"]|"")*"|[^",\r\n]*)(,|\r?\n|$)')


def csv_rows(body: str) -> Iterator[list[str]]:
    """The rows of COPY CSV, with cells as they are written."""
    row, at = [], 0
    while at < len(body):
        cell = _CELL.match(body, at)
        if cell is None:
            raise ValueError(f"a CSV cell can't be read: {body[at : at + 60]!r}")
        row.append(cell[1])
        at = cell.end()
        if cell[2] != ",":
            if row != [""]:  # an empty line
                yield row
            row = []
        elif at == len(body):
            yield [*row, ""]


def csv_value(cell: str) -> str | None:
    """The value of a cell of COPY CSV: an empty one is NULL, an empty quoted one an empty text."""
    return None if cell == "" else cell[1:-1].replace('""', '"') if cell[0] == '"' else cell


def _names(text: str | None) -> list[str]:
    return [normal(x) for x in text.split(",")] if text else []


def split_dump(text: str, strict_tables: set[str] | None = None) -> Iterator[Piece]:
    """The pieces of a dump, in order. strict_tables: their data must be readable."""
    at, n, held, ddl = 0, 0, 0, {}

    def flush(end: int) -> Iterator[Piece]:
        nonlocal n
        if end > held:
            n += 1
            yield Piece("other", text[held:end], n)

    while at < len(text):
        line = at
        if m := _COPY.match(text, line):
            yield from flush(at)
            n += 1
            table, form = normal(re.split(r"\s*\.\s*", m[1])[-1]), "csv" if "csv" in (m[3] or "").lower() else "copy"
            columns = _names(m[2]) or ddl.get(table, [])
            yield Piece("head", m[0], n, 0, form, table, columns)
            at = m.end()
            end = re.compile(r"^\\\.[ \t]*(?:\n|$)", re.MULTILINE).search(text, at)
            body = text[at : end.start() if end else len(text)]
            rows = csv_rows(body) if form == "csv" else (x.split("\t") for x in body.split("\n") if x)
            for i, cells in enumerate(rows, 1):
                names = columns or [f"col_{k}" for k in range(len(cells))]
                values = [csv_value(c) if form == "csv" else None if c == "\\N" else unescape(c) for c in cells]
                yield Piece("row", "", n, i, form, table, names, values, cells)
            yield Piece("end", end[0] if end else "", n, 1 << 40, form, table)
            at = held = end.end() if end else len(text)
            continue
        if m := _INSERT.match(text, line):
            yield from flush(at)
            n += 1
            table = normal(re.split(r"\s*\.\s*", m[1])[-1])
            columns = _names(m[2]) or ddl.get(table, [])
            yield Piece("head", m[0], n, 0, "insert", table, columns)
            at, i = m.end(), 0
            while at < len(text) and text[at] == "(":
                literals, at = _tuple(text, at)
                i += 1
                between = re.compile(r"\s*,\s*(?=\()").match(text, at)
                tail = ("," if between else text[at : _statement_end(text, at)])
                at = between.end() if between else _statement_end(text, at)
                names = columns or [f"col_{k}" for k in range(len(literals))]
                yield Piece("row", "", n, i, "insert", table, names, [literal_value(x) for x in literals], literals, tail)
            held = at
            continue
        if strict_tables and (m := _DATA.match(text, line)):
            statement = text[line : _statement_end(text, line)]
            if any(re.search(rf"\b{re.escape(t)}\b", statement, re.I) for t in strict_tables):
                raise ValueError(f"data for a table with rules can't be read: {statement.strip()[:120]!r}")
        if m := re.compile(rf"\s*CREATE\s+(?:\w+\s+)*?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_TABLE})\s*\(", re.I).match(text, line):
            body, _ = _tuple(text, m.end() - 1)
            ddl[normal(re.split(r"\s*\.\s*", m[1])[-1])] = [normal(x.split()[0]) for x in body if x and not re.match(r"(?:PRIMARY|FOREIGN|UNIQUE|CONSTRAINT|CHECK|KEY|INDEX)\b", x, re.I)]
        while line < len(text) and text[line] in " \t\r\n":
            line += 1
        if text.startswith(("--", "/*", "\\"), line):
            end = _skip(text, line) if text[line] != "\\" else text.find("\n", line) % (len(text) + 1)
            at = max(end, line + 1)
        else:
            at = _statement_end(text, line)
    yield from flush(len(text))


_SCHEMA = "file string, statement int, row long, kind string, form string, table string, columns array<string>, values array<string>, literals array<string>, text string, tail string"


def read_dump(spark: SparkSession, path: str, policy: Policy | None = None) -> DataFrame:
    """The pieces of the dumps at path. A file is split by one task, so large dumps should come in several files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    strict = {normal(t.rpartition(".")[2]) for t in policy.tables} if policy else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.list_(pa.string())
        arrow = pa.schema([("file", pa.string()), ("statement", pa.int32()), ("row", pa.int64()), ("kind", pa.string()), ("form", pa.string()), ("table", pa.string()), ("columns", texts), ("values", texts), ("literals", texts), ("text", pa.string()), ("tail", pa.string())])
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for p in split_dump(value, strict):
                    rows.append(vars(p) | {"file": file})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, _SCHEMA)


_TYPES = [(r"(?:big|small|tiny|medium)?(?:int|integer|serial)\b|int[248]\b|number\s*\(\s*\d+\s*\)", "bigint"), (r"numeric|decimal|number|real|float|double|money", "double"), (r"bool", "boolean")]


def ddl_types(pieces: DataFrame) -> dict[str, dict[str, str]]:
    """table -> column -> Spark type, from CREATE TABLE statements; all else is text."""
    found: dict[str, dict[str, str]] = {}
    statements = pieces.where("kind = 'other'").select("text").where(F.col("text").rlike(r"(?i)\bCREATE\b[^;]*\bTABLE\b"))
    for r in statements.collect():  # definitions, not data
        for m in re.finditer(rf"\bCREATE\s+(?:\w+\s+)*?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_TABLE})\s*\(", r.text, re.I):
            body, _ = _tuple(r.text, m.end() - 1)
            types = found.setdefault(normal(re.split(r"\s*\.\s*", m[1])[-1]), {})
            for part in body:
                if c := re.match(rf"({_NAME})\s+(.*)", part.strip(), re.DOTALL):
                    types[normal(c[1])] = next((t for pattern, t in _TYPES if re.match(pattern, c[2], re.I)), "string")
    return found


def dump_tables(pieces: DataFrame) -> dict[str, DataFrame]:
    """The tables of a dump, with the types of their definitions."""
    types = ddl_types(pieces)
    shapes: dict[str, list[str]] = {}
    for r in pieces.where("kind = 'row'").select("table", "columns").distinct().collect():  # a row for each table
        shapes.setdefault(r.table, [])
        shapes[r.table] += [c for c in r.columns if c not in shapes[r.table]]
    return {t: _table(pieces.where((F.col("kind") == "row") & (F.col("table") == t)), columns, types.get(t, {})) for t, columns in shapes.items()}


def _table(rows: DataFrame, columns: list[str], types: dict[str, str], *more: Column) -> DataFrame:
    cells = [F.get(F.col("values"), F.array_position("columns", F.lit(c)).cast("int") - 1).try_cast(types.get(c, "string")).alias(c) for c in columns]
    return rows.select(*more, *cells)


def mask_dump(spark: SparkSession, source: str, target: str, policy: Policy, **options: str) -> None:
    """Writes a masked copy of dumps: a folder of text, in the order of the statements, a row on a line of its own.

    What was one file stays in one file, so that no statement is cut from its rows or its table's definition. Dumps are
    split once, into a table in the shared folder that is deleted in the end.
    """
    held = scratch_path(spark, "dump-pieces")
    try:
        read_dump(spark, source, policy).write.parquet(held)
        _mask_pieces(spark.read.parquet(held), target, policy, **options)
    finally:
        discard(spark, held)


def _mask_pieces(pieces: DataFrame, target: str, policy: Policy, **options: str) -> None:
    types = ddl_types(pieces)
    shapes = pieces.where("kind = 'row'").select("table", "columns").distinct().collect()
    dropped = [r.table for r in shapes if (t := policy.table(r.table)) and t.truncate] + [normal(t.rpartition(".")[2]) for t, r in policy.tables.items() if r.truncate]
    keep = pieces.where(~((F.col("kind") != "other") & F.col("table").isin(*dropped))) if dropped else pieces
    place = ["file", "statement", "row"]
    text = F.when((F.col("kind") == "end") & (F.col("form") != "insert") & (F.col("text") == ""), "\\.").otherwise(F.col("text"))
    out = keep.where("kind <> 'row'").select(*place, text.alias("text"))
    for shape in shapes:
        if shape.table in dropped:
            continue
        rows = keep.where((F.col("kind") == "row") & (F.col("table") == shape.table) & (F.to_json("columns") == F.to_json(F.array(*[F.lit(c) for c in shape.columns]))))
        inner = [F.col(c).alias(f"__{c}") for c in (*place, "form", "literals", "tail")]
        before = _table(rows, shape.columns, types.get(shape.table, {}), *inner, F.col("values").alias("__values"))
        after = mask(before, shape.table, policy, **options)
        cells = []
        for i, c in enumerate(shape.columns):
            number = after.schema[c].dataType.typeName() in ("long", "integer", "double", "float", "decimal", "short", "byte")
            new, was = F.col(c).cast("string"), F.get(F.col("__literals"), F.lit(i))
            same = new.eqNullSafe(F.get(F.col("__values"), F.lit(i)).try_cast(types.get(shape.table, {}).get(c, "string")).cast("string"))
            quoted = F.concat(F.when(was.rlike("^[Nn]'"), "N").otherwise(""), F.lit("'"), F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
            insert = F.when(new.isNull(), "NULL").otherwise(new if number else quoted)
            escaped = F.replace(F.replace(F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
            quoted_cell = F.concat(F.lit('"'), F.replace(new, F.lit('"'), F.lit('""')), F.lit('"'))
            comma = F.when((new == "") | new.rlike('[",\r\n]'), quoted_cell).otherwise(F.coalesce(new, F.lit("")))
            made = F.when(F.col("__form") == "insert", insert).when(F.col("__form") == "csv", comma).otherwise(F.coalesce(escaped, F.lit("\\N")))
            cells.append(F.when(same, was).otherwise(made))
        line = F.when(F.col("__form") == "insert", F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")"), F.col("__tail"))).when(F.col("__form") == "csv", F.concat_ws(",", *cells)).otherwise(F.concat_ws("\t", *cells))
        out = out.unionByName(after.select(*[F.col(f"__{c}").alias(c) for c in place], line.alias("text")))
    ordered = out.repartitionByRange("file").sortWithinPartitions(*place)
    ordered.select(F.regexp_replace("text", r"\r?\n$", "").alias("text")).write.text(target)
