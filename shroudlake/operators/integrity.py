"""Referential integrity: collision-free numbers, and foreign keys from DDL or data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.crypto import canon, hmac_sha256, u64_mod
from ..plans.policy import ConsistencyGroup, normal
from ..shared import durable

#: Rounds after which a range is too full for new numbers to be found in reasonable time.
MOST_ROUNDS = 200


def unique_mapping(values: DataFrame, column: str, salt: str, min_int: int = 100000, max_int: int = 999999999, known: DataFrame | None = None) -> DataFrame:
    """(value, token): a different number for each distinct value, as text, independent of row order and partitions.

    A value tries its keyed hash, then the hashes with counters 1, 2, ...; of several values that try a number in one
    round the first by text gets it, and numbers that `known` (an earlier mapping) or earlier rounds gave stay given. It is an error
    if there are more values than numbers.
    """
    span = max_int - min_int + 1
    todo = values.select(canon(F.col(column), values.schema[column].dataType).alias("value")).where("value IS NOT NULL").distinct()
    done = known.select("value", "token") if known is not None else None
    if done is not None:
        todo = todo.join(done, "value", "left_anti")
    todo = durable(todo)
    have = 0 if done is None else done.count()
    if (n := todo.count()) + have > span:
        raise ValueError(f"{n + have} values don't fit into the {span} numbers from {min_int} to {max_int}")
    for counter in range(MOST_ROUNDS):
        text = F.col("value") if counter == 0 else F.concat(F.col("value"), F.lit(f":{counter}"))
        tries = todo.withColumn("token", u64_mod(hmac_sha256(text, salt), span) + F.lit(min_int).cast("long"))
        if done is not None:  # of what is given only the numbers that are tried matter, which get few soon
            taken = done.select("token").join(tries.select("token").distinct(), "token", "left_semi")
            tries = tries.join(taken, "token", "left_anti").select("value", "token")
        # each round writes what it gave, and nothing again
        won = durable(tries.groupBy("token").agg(F.min("value").alias("value")).select("value", "token"))
        done = won if done is None else done.unionByName(won)
        todo = durable(todo.join(won.select("value"), "value", "left_anti"))
        if todo.isEmpty():
            return done
    # nearly full: the rest takes free numbers in order
    taken = Window.orderBy("token")
    spare = values.sparkSession.range(min_int, max_int + 1).select(F.col("id").alias("token")).join(done.select("token"), "token", "left_anti").limit(todo.count()).withColumn("_n", F.row_number().over(taken))
    rest = todo.withColumn("_n", F.row_number().over(Window.orderBy("value"))).join(spare, "_n").select("value", "token")
    return done.unionByName(rest)


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """df with a column replaced by its tokens; null stays null."""
    kind = df.schema[column].dataType
    tokens = mapping.select(F.col("value").alias("_value"), F.col("token").alias("_token"))
    joined = df.withColumn("_value", canon(F.col(column), kind)).join(tokens, "_value", "left")
    return joined.select(*[F.col("_token").alias(c) if c == column else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class ForeignKey:
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


_NAME = r"(?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])"
_TABLE = rf"{_NAME}(?:\s*\.\s*{_NAME})*"
_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", re.DOTALL)
_CREATE = re.compile(rf"\bCREATE\s+(?:\w+\s+)*?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_TABLE})\s*\(", re.I)
_ALTER = re.compile(rf"\bALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?({_TABLE})\s+([^;]*)", re.I | re.DOTALL)
_KEY = re.compile(rf"\bFOREIGN\s+KEY\s*(?:{_NAME}\s*)?\(([^)]*)\)\s*REFERENCES\s+({_TABLE})\s*(?:\(([^)]*)\))?", re.I)
_INLINE = re.compile(rf"^\s*({_NAME})\s+.*?\bREFERENCES\s+({_TABLE})\s*(?:\(([^)]*)\))?", re.I | re.DOTALL)


def _last(name: str) -> str:
    return normal(re.split(r"\s*\.\s*", name.strip())[-1])


def _list(text: str | None) -> tuple[str, ...]:
    return tuple(normal(x) for x in text.split(",")) if text else ()


def _body(ddl: str, start: int) -> str:
    """What stands between the parenthesis before start and the one that closes it."""
    depth = 1
    for i in range(start, len(ddl)):
        depth += {"(": 1, ")": -1}.get(ddl[i], 0)
        if depth == 0:
            return ddl[start:i]
    return ddl[start:]


def _parts(body: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(body):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and depth == 0:
            out.append(body[at:i])
            at = i + 1
    return [*out, body[at:]]


def foreign_keys(ddl: str) -> list[ForeignKey]:
    """The foreign keys of CREATE TABLE and ALTER TABLE statements, each once, single or composite, in any notation."""
    ddl = _TOKEN.sub(" ", ddl)
    found: dict[ForeignKey, None] = {}

    def add(child: str, columns: tuple[str, ...], parent: str, parents: tuple[str, ...]) -> None:
        found[ForeignKey(child, columns, _last(parent), parents or (("id",) if len(columns) == 1 else columns))] = None

    for m in _CREATE.finditer(ddl):
        child = _last(m[1])
        for part in _parts(_body(ddl, m.end())):
            if k := _KEY.search(part):
                add(child, _list(k[1]), k[2], _list(k[3]))
            elif k := _INLINE.match(part):
                add(child, (normal(k[1]),), k[2], _list(k[3]))
    for m in _ALTER.finditer(ddl):
        for k in _KEY.finditer(m[2]):
            add(_last(m[1]), _list(k[1]), k[2], _list(k[3]))
    return list(found)


def groups_of(keys: list[ForeignKey]) -> list[ConsistencyGroup]:
    """One consistency group for each set of columns that keys connect."""
    sets: list[set[str]] = []
    for k in keys:
        name = lambda t, cols: f"{t}.{cols[0]}" if len(cols) == 1 else f"{t}.({', '.join(cols)})"
        new = {name(k.child, k.child_columns), name(k.parent, k.parent_columns)}
        touched = [s for s in sets if s & new]
        sets = [s for s in sets if not s & new] + [new.union(*touched)]
    return [ConsistencyGroup(name="fk_" + re.sub(r"\W+", "_", min(s)).strip("_"), columns=sorted(s), params={"as_integer": True}) for s in sorted(sets, key=min)]


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of the child whose key no parent has; rows with a null in it are none."""
    on = None
    for a, b in zip(columns, parent_columns, strict=True):
        part = child[a] == parent[b]
        on = part if on is None else on & part
    whole = F.lit(True)
    for a in columns:
        whole = whole & child[a].isNotNull()
    return child.where(whole).join(parent, on, "left_anti")
