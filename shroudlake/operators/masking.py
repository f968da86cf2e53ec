"""Masking of tables under a policy: one projection, or a few where rules read each other's results."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crypto import canon, hmac_sha256, u64_mod
from ..plans.conditions import compile_condition, names_in
from ..plans.policy import ColumnRule, Policy, normal
from . import json_mask, strategies  # noqa: F401  (they register themselves)
from .registry import MaskContext, build, lookup

#: Columns that tell when a row changed, in order of preference.
CHANGE_COLUMNS = ("updated_at", "created_at", "modified_at", "timestamp", "date")


def _columns(df: DataFrame) -> dict[str, T.StructField]:
    return {normal(f.name): f for f in df.schema.fields}


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def composite_tokens(columns: list[Column], kinds: list[T.DataType], group: str, salt: str) -> list[Column]:
    """A token for each column of a composite key, from all of its values; null if one of them is null.

    Values enter with their length in front, so that no two keys have the same text.
    """
    texts = [canon(c, k) for c, k in zip(columns, kinds, strict=True)]
    whole = F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t, F.lit(",")) for t in texts])
    out = []
    for i, kind in enumerate(kinds):
        digest = hmac_sha256(F.concat(F.lit(f"{group}:"), whole, F.lit(f":{i}")), salt)
        whole_number = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        out.append(u64_mod(digest, 899_999) + 100_000 if whole_number else F.substring(digest, 1, 16))
    return out


def change_column(df: DataFrame, column: str | None = None) -> str | None:
    """The column that tells when a row changed."""
    names = _columns(df)
    wanted = [normal(column)] if column else CHANGE_COLUMNS
    return next((names[c].name for c in wanted if c in names), None)


def _is_old(df: DataFrame, since: str | None, column: str | None) -> Column | None:
    """Whether a row is from before `since`, so that it passes as it is; by text, or by time where the type is one."""
    name = change_column(df, column) if since else None
    if name is None:
        return None
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(_col(name).cast("timestamp_ntz") < F.lit(since).cast("timestamp_ntz"), F.lit(False))
    return F.coalesce(canon(_col(name), kind) < F.lit(since), F.lit(False))


class Plan:
    """The compiled rules of one table: stages of expressions, and what each cell's change depends on."""

    def __init__(self, df: DataFrame, table: str, policy: Policy, since: str | None = None, since_column: str | None = None, strict: bool = False, condition_on: str = "masked", type_policy: str = "widen"):
        self.policy, self.table, self.type_policy, self.strict = policy, table, type_policy, strict
        self.names, self.rule = _columns(df), policy.table(table)
        self.old = _is_old(df, since, since_column)
        self.condition_on = condition_on
        self.cells: dict[str, list[ColumnRule]] = {}
        if self.rule:
            for name, rule in self.rule.columns.items():
                if normal(name) in self.names:
                    self.cells[normal(name)] = [rule]

    def context(self, column: str, rule: ColumnRule) -> tuple[MaskContext, str, dict[str, Any]]:
        """What a rule's strategy gets, its name and parameters, with those of its group."""
        group = self.policy.group_of(self.table, column)
        settings = self.policy.settings
        keys = [self.names[normal(k)].name for k in (self.rule.key if self.rule else []) if normal(k) in self.names]
        nonce = F.concat_ws("|", *[_col(k).cast("string") for k in keys]) if keys else None
        ctx = MaskContext(normal(self.table.rpartition(".")[2]), column, settings.salt, settings.locale, rule.consistency_group or (group.name if group else None), nonce, rule.keep_null)
        params = (dict(group.params) if group else {}) | rule.params
        return ctx, group.strategy if group else rule.strategy, params

    def apply(self, df: DataFrame) -> DataFrame:
        start = df
        originals = {c: f"__was_{i}" for i, c in enumerate(self.names)} if self._needs_originals() else {}
        if originals:
            df = df.select("*", *[_col(self.names[c].name).alias(o) for c, o in originals.items()])
        df = self._composites(df)
        stage: dict[str, Column] = {}
        for column, (rule,) in self.cells.items():
            reads = names_in(rule.condition) if self.condition_on == "masked" else set()
            if reads & set(stage):  # it sees what earlier rules made of those columns
                df, stage = df.withColumns(stage), {}
            stage[self.names[column].name] = self._cell(df, column, rule, originals)
        df = df.withColumns(stage) if stage else df
        return df.select(*[_col(c) for c in start.columns])

    def _needs_originals(self) -> bool:
        return self.condition_on == "original" or self.old is not None and bool(self.policy.composites(self.table))

    def _composites(self, df: DataFrame) -> DataFrame:
        for group, columns in self.policy.composites(self.table):
            if not all(c in self.names for c in columns):
                continue
            fields = [df.schema[self.names[c].name] for c in columns]
            tokens = composite_tokens([_col(f.name) for f in fields], [f.dataType for f in fields], group.name, self.policy.settings.salt)
            made = {}
            for f, token in zip(fields, tokens, strict=True):
                value = self._as(_col(f.name), f.dataType, df, token)
                new = F.coalesce(token, value)  # a token is null if a column of the key is
                made[f.name] = new if self.old is None else F.when(self.old, value).otherwise(new)
            df = df.withColumns(made)
        return df

    def _cell(self, df: DataFrame, column: str, rule: ColumnRule, originals: dict[str, str]) -> Column:
        field = df.schema[self.names[column].name]
        value = _col(field.name)
        ctx, name, params = self.context(column, rule)
        out = build(name, value, field.dataType, ctx, params)
        if self.type_policy == "preserve":
            out = out.try_cast(field.dataType)
        applies = None
        if rule.condition and rule.condition.strip():
            seen = {c: (_col(originals[c] if self.condition_on == "original" and c in originals else f.name), df.schema[f.name].dataType) for c, f in self.names.items()}
            applies = compile_condition(rule.condition, seen, self.strict)
        if rule.condition_sql:
            more = F.coalesce(F.expr(rule.condition_sql), F.lit(False))
            applies = more if applies is None else applies & more
        if self.old is not None:
            applies = ~self.old if applies is None else applies & ~self.old
        if rule.keep_null and not (applies is None and lookup(name)[0].null_safe):
            # around a branch Spark computes what it would otherwise share, so there is none without need
            applies = value.isNotNull() if applies is None else applies & value.isNotNull()
        return out if applies is None else F.when(applies, out).otherwise(self._as(value, field.dataType, df, out))

    def _as(self, value: Column, kind: T.DataType, df: DataFrame, out: Column) -> Column:
        """The value in the type of the masked one, so that both fit one column."""
        made = df.select(out.alias("v")).schema["v"].dataType
        return value if made == kind else canon(value, kind) if isinstance(made, T.StringType) else value.try_cast(made)


def mask(df: DataFrame, table: str, policy: Policy, **options: Any) -> DataFrame:
    """df masked by the policy's rules for the table; without rules, df itself. Runs no job.

    Options: since and since_column (rows from before pass unchanged), strict (conditions that don't compile are
    errors), condition_on ("masked" or "original"), type_policy ("widen" or "preserve").
    """
    rule = policy.table(table)
    if rule is None and not policy.composites(table):
        return df
    if rule is not None and rule.where_clause:
        df = df.where(F.expr(rule.where_clause))
    if rule is not None and rule.truncate:
        return df.where(F.lit(False))
    for r in (rule.columns if rule else {}).values():
        lookup(r.strategy)
    return Plan(df, table, policy, **options).apply(df)


def mask_database(tables: dict[str, DataFrame], policy: Policy, **options: Any) -> dict[str, DataFrame]:
    """Every table masked; tables without rules stay."""
    return {name: mask(df, name, policy, **options) for name, df in tables.items()}


def budget(df: DataFrame, table: str, policy: Policy) -> DataFrame:
    """The privacy budget that masking a table spends: epsilon and delta for each noised cell, added up."""
    plan = Plan(df, table, policy)
    parts = []
    for column, (rule,) in plan.cells.items():
        ctx, name, params = plan.context(column, rule)
        strategy, preset = lookup(name)
        params = preset | params
        if strategy.name != "differential_privacy" or not params.get("track_budget", True):
            continue
        gaussian = params.get("mechanism", "laplace").lower() in ("gaussian", "normal")
        spent = F.count(F.when(_col(plan.names[column].name).try_cast("double").isNotNull(), 1))
        parts.append((spent * F.lit(float(params.get("epsilon", 1.0))), spent * F.lit(float(params.get("delta", 1e-5)) if gaussian else 0.0)))
    zero = F.lit(0.0)
    epsilon, delta = sum((p[0] for p in parts), zero), sum((p[1] for p in parts), zero)
    return df.agg(F.round(epsilon, 6).alias("epsilon_total"), F.round(delta, 9).alias("delta_total"))


def observed(df: DataFrame, table: str, policy: Policy, **options: Any) -> tuple[DataFrame, Observation]:
    """mask() with counters that fill while the result is written: rows, and masked cells."""
    out = mask(df, table, policy, **options)
    seen, plan = Observation(f"mask-{table}"), Plan(df, table, policy, **options)
    old = F.lit(False) if plan.old is None else plan.old
    cells = sum((F.count(F.when(_col(plan.names[c].name).isNotNull() & ~old, 1)) if r[0].keep_null else F.count(F.when(~old, 1)) for c, r in plan.cells.items()), F.lit(0))
    watched = df.observe(seen, F.count("*").alias("rows"), cells.alias("cells"))
    rule = policy.table(table)
    return (mask(watched, table, policy, **options) if rule is None or not rule.truncate else out), seen


def changed(before: DataFrame, after: dict[str, Column]) -> dict[str, Column]:
    """For each column, whether its masked value differs."""
    return {name: ~_col(name).cast("string").eqNullSafe(c.cast("string")) for name, c in after.items()}
