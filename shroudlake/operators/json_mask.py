"""Masking inside JSON texts and nested columns."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import MaskContext, build, register

_STEP = re.compile(r"([^.\[\]]+)|\[(\*|\d+)\]")


def path_steps(path: str) -> list[str | int]:
    """`a.b[*].c[0].*` as steps: names, indices and "*"; "[*]" is for arrays and "*" for objects."""
    steps: list[str | int] = []
    for name, index in _STEP.findall(path.strip()):
        if name:
            if name.strip():
                steps.append(name.strip())
        else:
            steps.append("[*]" if index == "*" else int(index))
    return steps


def _rule(rule: Any) -> tuple[str, dict, bool]:
    if isinstance(rule, str):
        return rule, {}, True
    if isinstance(rule, dict):
        return rule.get("strategy", "nullify"), dict(rule.get("params") or {}), rule.get("keep_null", True)
    return rule.strategy, dict(rule.params), rule.keep_null


def _masked(c: Column, kind: T.DataType, rule: Any, ctx: MaskContext) -> Column:
    name, params, keep_null = _rule(rule)
    out = build(name, c, kind, ctx, params)
    return F.when(c.isNotNull(), out) if keep_null else out


def mask_nested(c: Column, kind: T.DataType, steps: list, rule: Any, ctx: MaskContext) -> Column:
    """A nested column with what the steps lead to masked; steps that lead nowhere change nothing."""
    if not steps:
        return _masked(c, kind, rule, ctx)
    step, rest = steps[0], steps[1:]
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            if step == "*" or step == f.name:
                c = c.withField(f"`{f.name}`", mask_nested(c[f.name], f.dataType, rest, rule, ctx))
        return c
    if isinstance(kind, T.ArrayType):
        if step == "[*]":
            return F.transform(c, lambda x: mask_nested(x, kind.elementType, rest, rule, ctx))
        if isinstance(step, int):
            return F.transform(c, lambda x, i: F.when(i == step, mask_nested(x, kind.elementType, rest, rule, ctx)).otherwise(x))
        return c
    if isinstance(kind, T.MapType):
        one = lambda k, v: mask_nested(v, kind.valueType, rest, rule, ctx)
        if step == "*":
            return F.transform_values(c, one)
        return F.transform_values(c, lambda k, v: F.when(k == str(step), one(k, v)).otherwise(v))
    return c


def _leaves(data: Any, steps: list, visit: Any) -> Any:
    """data with visit(leaf) at the end of the steps."""
    if not steps:
        return visit(data)
    step, rest = steps[0], steps[1:]
    if step == "[*]" and isinstance(data, list):
        return [_leaves(x, rest, visit) for x in data]
    if isinstance(step, int) and isinstance(data, list) and step < len(data):
        return [_leaves(x, rest, visit) if i == step else x for i, x in enumerate(data)]
    if step == "*" and isinstance(data, dict):
        return {k: _leaves(v, rest, visit) for k, v in data.items()}
    if isinstance(data, dict) and step in data:
        return {k: _leaves(v, rest, visit) if k == step else v for k, v in data.items()}
    return data


def _pulled(paths: list[list]) -> Any:
    """JSON text -> the leaves of the paths, in order, as (JSON) texts."""

    @F.pandas_udf("array<struct<path:int,text:string,kind:string>>")
    def pull(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list:
            found: list = []
            try:
                data = json.loads(text) if text and text.strip()[:1] in ("{", "[") else None
            except ValueError:
                data = None
            for i, steps in enumerate(paths if data is not None else []):

                def visit(v: Any, i: int = i) -> Any:
                    kind = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "text" if isinstance(v, str) else "json"
                    found.append({"path": i, "text": v if kind == "text" else None if v is None else json.dumps(v), "kind": kind})
                    return v

                _leaves(data, steps, visit)
            return found

        return texts.map(one)

    return pull


def _put_back(paths: list[list], on_error: str, ascii_only: bool) -> Any:
    """(JSON text, masked leaves as JSON texts) -> JSON text."""

    @F.pandas_udf("string")
    def put(texts: pd.Series, leaves: pd.Series) -> pd.Series:
        def one(text: str | None, masked: Any) -> str | None:
            if text is None or text.strip()[:1] not in ("{", "["):
                return text
            try:
                data = json.loads(text)
            except ValueError as e:
                if on_error == "raise":
                    raise ValueError(f"not JSON: {e}") from e
                return text
            values = iter(list(masked) if masked is not None else [])
            for steps in paths:
                data = _leaves(data, steps, lambda _: (lambda m: None if m is None else json.loads(m))(next(values)))
            return json.dumps(data, ensure_ascii=ascii_only)

        return pd.Series([one(t, m) for t, m in zip(texts, leaves, strict=True)], dtype="object")

    return put


def _leaf_column(leaf: Column, rule: Any, ctx: MaskContext) -> Column:
    """A masked leaf as JSON, by the kind of value that it was."""
    name, params, keep_null = _rule(rule)
    text = leaf["text"]

    def encoded(c: Column, kind: T.DataType) -> Column:
        out = build(name, c, kind, ctx, params)
        whole = F.to_json(F.struct(out.alias("v")), {"ignoreNullFields": "false"})
        return F.substr(whole, F.lit(6), F.length(whole) - 6)

    masked = (
        F.when(leaf["kind"] == "int", encoded(text.try_cast("long"), T.LongType()))
        .when(leaf["kind"] == "float", encoded(text.try_cast("double"), T.DoubleType()))
        .when(leaf["kind"] == "bool", encoded(text.try_cast("boolean"), T.BooleanType()))
        .otherwise(encoded(text, T.StringType()))
    )
    return F.when(leaf["kind"] == "null", F.lit(None).cast("string")).otherwise(masked) if keep_null else masked


@register("json_mask", "json", "jsonb")
def json_mask(c: Column, kind: T.DataType, ctx: MaskContext, *, rules: dict | None = None, error_handling: str = "passthrough", ensure_ascii: bool = False) -> Column:
    """Strategies at paths of a JSON text or a nested column; what isn't JSON passes or is an error."""
    if not rules:
        return c
    if not isinstance(kind, T.StringType):
        for path, rule in rules.items():
            c = mask_nested(c, kind, path_steps(path), rule, ctx)
        return c
    # Leaves are pulled out and put back in Arrow batches, which keeps the text exact; in between they are masked by
    # the same expressions as columns. A path that reads what another one masked goes to the next turn.
    for path, rule in rules.items():
        steps = [path_steps(path)]
        leaves = F.transform(_pulled(steps)(c), _leaf_function(rule, ctx))
        c = _put_back(steps, error_handling, ensure_ascii)(c, leaves)
    return c


def _leaf_function(rule: Any, ctx: MaskContext) -> Any:
    def one(x: Column) -> Column:
        return _leaf_column(x, rule, ctx)

    return one


def schema_of(spark: SparkSession, text: str) -> T.StructType:
    """The schema of JSON texts, from an example, for nested masking of from_json columns."""
    return spark.range(1).select(F.from_json(F.lit(text), F.schema_of_json(F.lit(text))).alias("v")).schema["v"].dataType
