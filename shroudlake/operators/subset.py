"""Subsets of a database that keep every foreign key whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policy import normal
from ..shared import durable
from .integrity import ForeignKey


#: Rounds after which a chain of references counts as endless.
MOST_ROUNDS = 1000


def _reach(keys: list[ForeignKey]) -> dict[str, set[str]]:
    """For each table the tables that refer to it, at any distance."""
    out: dict[str, set[str]] = {}
    for t in {k.parent for k in keys}:
        found, more = set(), {t}
        while more := {k.child for k in keys if k.parent in more} - found:
            found |= more
        out[t] = found
    return out


def _ordered(tables: set[str], keys: list[ForeignKey]) -> list[list[str]]:
    """Parents before children; tables that refer to each other in a circle, or to themselves, are one step."""
    reach, out, left = _reach([k for k in keys if k.child in tables and k.parent in tables]), [], set(tables)
    while left:
        ready = min(t for t in left if all(u == t or u not in left or t in reach.get(u, ()) and u in reach.get(t, ()) for u in left if t in reach.get(u, ())))
        step = sorted(u for u in left if u == ready or u in reach.get(ready, ()) and ready in reach.get(u, ()))
        out.append(step)
        left -= set(step)
    return out


def _keys_of(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The distinct keys without nulls, as _k0, _k1, ..."""
    return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)]).na.drop().distinct()


def _found(df: DataFrame, columns: tuple[str, ...], keys: DataFrame, name: str) -> DataFrame:
    """df with a column that tells whether the row's key is among the keys; one scan of df, whatever the nulls."""
    marked = keys.withColumn(name, F.lit(True))
    on = None
    for i, c in enumerate(columns):
        part = df[c] == marked[f"_k{i}"]
        on = part if on is None else on & part
    out = df.join(marked, on, "left")
    return out.select(*[df[c] for c in df.columns], F.coalesce(marked[name], F.lit(False)).alias(name))


def _whole(df: DataFrame, keys: list[tuple[tuple[str, ...], DataFrame]]) -> DataFrame:
    """The rows all of whose keys are among the given ones or have a null in them."""
    columns, kept = df.columns, df
    for i, (cols, known) in enumerate(keys):
        kept = _found(kept, cols, known, f"_found{i}")
        missing = F.lit(False)
        for c in cols:
            missing = missing | F.col(c).isNull()
        kept = kept.where(F.col(f"_found{i}") | missing)
    return kept.select(*columns)


def _closed(tables: dict[str, DataFrame], keys: list[ForeignKey], root: str, first: DataFrame, root_key: str) -> dict[str, DataFrame]:
    """The first rows of the root, and what they refer to in tables that refer back to it, at any distance.

    Only keys are kept from round to round: those that are wanted, and the rows that the last round added.
    """
    wanted: dict[tuple[str, tuple[str, ...]], DataFrame] = {(root, (root_key,)): durable(_keys_of(first, (root_key,)))}
    last = {root: first}
    for _ in range(MOST_ROUNDS):
        new: dict[tuple[str, tuple[str, ...]], DataFrame] = {}
        for k in keys:
            if k.child in last:
                more = _keys_of(last[k.child], k.child_columns)
                at = (k.parent, k.parent_columns)
                new[at] = new[at].union(more) if at in new else more
        for at, df in list(new.items()):
            names = [f"_k{i}" for i in range(len(at[1]))]
            new[at] = durable(df.distinct().join(wanted[at], names, "left_anti") if at in wanted else df.distinct())
            if new[at].isEmpty():
                del new[at]
        if not new:
            break
        last = {}
        for (table, cols), df in new.items():
            rows = _found(tables[table], cols, df, "_new").where("_new").drop("_new")
            last[table] = last[table].unionByName(rows) if table in last else rows
            wanted[table, cols] = durable(wanted[table, cols].union(df)) if (table, cols) in wanted else df
    else:
        raise RuntimeError(f"the references of {root} don't end")
    out = {}
    for table in {t for t, _ in wanted}:
        df, hit = tables[table], F.lit(False)
        for i, ((t, cols), known) in enumerate(wanted.items()):
            if t == table:
                df, hit = _found(df, cols, known, f"_want{i}"), hit | F.col(f"_want{i}")
        out[table] = df.where(hit).select(*tables[table].columns)
    return out


def subset(tables: dict[str, DataFrame], keys: list[ForeignKey], root: str, limit: int | None = None, where: str | None = None, root_key: str | None = None, upstream: bool = False) -> dict[str, DataFrame]:
    """The first rows of a root table by its key (or those of a condition), and of all other tables what belongs to them.

    A table that refers, at any distance, to the root keeps the rows all of whose foreign keys meet kept rows; a null key is no
    hindrance. Where the root refers to itself, or to tables that refer to it, what its rows refer to is kept too; other
    tables on a circle lose rows until every key meets a row. Tables without a path to the root stay whole; with
    upstream, tables that kept rows refer to are cut to what is referred to. Joins run on keys alone, and each table is
    scanned once for its rows.
    """
    names = {normal(t): t for t in tables}
    keys = [k for k in keys if k.child in names and k.parent in names]
    by_name = {n: tables[t] for n, t in names.items()}
    root = normal(root)
    first = by_name[root]
    if where:
        first = first.where(F.expr(where))
    key = root_key or first.columns[0]
    if limit is not None:
        first = first.orderBy(key).limit(limit)
    reached = {root} | _reach(keys).get(root, set())
    core = {t for t in reached if t == root or root in _reach(keys).get(t, set())}
    inner = [k for k in keys if k.child in core and k.parent in core]
    kept = {root: durable(first)}
    if inner:
        closed = _closed(by_name, inner, root, kept[root], key)
        kept = {t: closed[t] if t in closed else by_name[t].limit(0) for t in core}
    known: dict[tuple[str, tuple[str, ...]], DataFrame] = {}

    def keys_in(table: str, columns: tuple[str, ...]) -> DataFrame:
        if (table, columns) not in known:
            known[table, columns] = _keys_of(kept[table], columns)
        return known[table, columns]

    for step in _ordered(reached - core, keys):
        for t in step:
            outer = [(k.child_columns, keys_in(k.parent, k.parent_columns)) for k in keys if k.child == t and k.parent in kept]
            kept_now = _whole(by_name[t], outer)
            if any(k.child == t and k.parent in step for k in keys):
                kept_now = durable(kept_now)
            kept[t] = kept_now
        ring = [k for k in keys if k.child in step and k.parent in step]
        rows = -1
        for _ in range(MOST_ROUNDS if ring else 0):
            for t in step:
                kept[t] = durable(_whole(kept[t], [(k.child_columns, _keys_of(kept[k.parent], k.parent_columns)) for k in ring if k.child == t]))
            now = sum(kept[t].count() for t in step)
            if now == rows:
                break
            rows = now
    if upstream:
        for step in reversed(_ordered(set(names) - set(kept), keys)):
            for table in step:
                users = [k for k in keys if k.parent == table and k.child in kept and k.child != table]
                if users:
                    df, hit = by_name[table], F.lit(False)
                    for i, k in enumerate(users):
                        df, hit = _found(df, k.parent_columns, _keys_of(kept[k.child], k.child_columns), f"_used{i}"), hit | F.col(f"_used{i}")
                    kept[table] = df.where(hit).select(*by_name[table].columns)
    return {t: kept.get(n, tables[t]) for n, t in names.items()}


def subset_stats(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table, rows_in, rows_out, reduction_pct) of each table."""
    parts = None
    for name in before:
        for df, side in ((before[name], "rows_in"), (after[name], "rows_out")):
            row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(side).alias("side"), "n")
            parts = row if parts is None else parts.unionByName(row)
    sides = parts.groupBy("table").agg(*[F.sum(F.when(F.col("side") == s, F.col("n"))).alias(s) for s in ("rows_in", "rows_out")])
    return sides.withColumn("reduction_pct", F.when(F.col("rows_in") > 0, F.round(100.0 * (F.col("rows_in") - F.col("rows_out")) / F.col("rows_in"), 2)).otherwise(0.0))
