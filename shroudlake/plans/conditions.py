"""The condition language of rules, compiled from Python's expression grammar to a Column."""

from __future__ import annotations

import ast
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .policy import normal

_NUMBER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_COMPARE: dict[type, Any] = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_ARITHMETIC: dict[type, Any] = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b)}


class Unsupported(ValueError):
    """A part of a condition that the language doesn't have."""


class _Value:
    """A compiled part: its column, and its kind (number, text, bool, null, time, list or other)."""

    def __init__(self, column: Column | None, kind: str, items: list[_Value] | None = None):
        self.column, self.kind, self.items = column, kind, items or []


def _kind_of(t: T.DataType) -> str:
    if isinstance(t, _NUMBER):
        return "number"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "time" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


class _Compiler:
    def __init__(self, columns: dict[str, tuple[Column, T.DataType]], strict: bool):
        self.columns, self.strict = columns, strict

    def value(self, node: ast.AST) -> _Value:
        if isinstance(node, ast.Constant):
            v = node.value
            if v is None:
                return _Value(F.lit(None), "null")
            if isinstance(v, bool):
                return _Value(F.lit(v), "bool")
            if isinstance(v, (int, float)):
                return _Value(F.lit(v), "number")
            if isinstance(v, str):
                return _Value(F.lit(v), "text")
            raise Unsupported(f"constant {v!r}")
        if isinstance(node, ast.Name):
            found = self.columns.get(normal(node.id))
            return _Value(found[0], _kind_of(found[1])) if found else _Value(F.lit(None), "null")
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return _Value(None, "list", [self.value(x) for x in node.elts])
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.Not):
                return _Value(~self.truth(node.operand), "bool")
            inner = self.value(node.operand)
            if inner.kind != "number":
                raise Unsupported("a sign before something that isn't a number")
            return _Value(-inner.column if isinstance(node.op, ast.USub) else inner.column, "number")
        if isinstance(node, ast.BinOp):
            a, b, op = self.value(node.left), self.value(node.right), _ARITHMETIC.get(type(node.op))
            if op is None:
                raise Unsupported(type(node.op).__name__)
            if isinstance(node.op, ast.Add) and a.kind == b.kind == "text":
                return _Value(F.concat(a.column, b.column), "text")
            return _Value(op(self.number(a), self.number(b)), "number")
        if isinstance(node, (ast.BoolOp, ast.Compare)):
            return _Value(self.truth(node), "bool")
        raise Unsupported(type(node).__name__)

    def number(self, v: _Value) -> Column:
        if v.kind == "number":
            return v.column
        if v.kind == "text" and not self.strict:
            return v.column.try_cast("double")
        raise Unsupported(f"arithmetic with {v.kind}")

    def truth(self, node: ast.AST) -> Column:
        """Python's truth of a part; never null."""
        if isinstance(node, ast.BoolOp):
            parts = [self.truth(x) for x in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.Compare):
            out, left = None, self.value(node.left)
            for op, right_node in zip(node.ops, node.comparators, strict=True):
                right = self.value(right_node)
                part = F.coalesce(self.compare(op, left, right), F.lit(False))
                out, left = part if out is None else out & part, right
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.truth(node.operand)
        v = self.value(node)
        if v.kind == "list":
            return F.lit(bool(v.items))
        if v.kind == "null":
            return F.lit(False)
        test = {"bool": lambda c: c, "number": lambda c: c != 0, "text": lambda c: F.length(c) > 0}.get(v.kind, lambda c: c.isNotNull())
        return F.coalesce(test(v.column), F.lit(False))

    def compare(self, op: ast.cmpop, a: _Value, b: _Value) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if b.kind == "list":
                found = F.lit(False)
                for item in b.items:
                    found = found | F.coalesce(self.equal(a, item), F.lit(False))
            elif b.kind == "text" and a.kind == "text":
                found = F.coalesce(b.column.contains(a.column), F.lit(False))
            else:
                raise Unsupported("membership in something that isn't a list")
            return found if isinstance(op, ast.In) else ~found
        if isinstance(op, (ast.Is, ast.IsNot)):
            same = self.equal(a, b)
            return same if isinstance(op, ast.Is) else ~same
        if isinstance(op, ast.Eq):
            return self.equal(a, b)
        if isinstance(op, ast.NotEq):
            return ~self.equal(a, b)
        x, y = self.aligned(a, b)
        return _COMPARE[type(op)](x, y)

    def equal(self, a: _Value, b: _Value) -> Column:
        """Equality in which null equals null alone, as None does."""
        if a.kind == "null" or b.kind == "null":
            other = b if a.kind == "null" else a
            return F.lit(True) if other.kind == "null" else other.column.isNull()
        if self.strict and {a.kind, b.kind} == {"text", "number"}:
            raise Unsupported("a comparison of text with a number")
        x, y = self.aligned(a, b)
        return x.eqNullSafe(y)

    def aligned(self, a: _Value, b: _Value) -> tuple[Column, Column]:
        kinds = {a.kind, b.kind}
        if kinds == {"text", "number"}:
            if self.strict:
                raise Unsupported("a comparison of text with a number")
            return self.number(a), self.number(b)
        if kinds == {"time", "text"}:
            cast = lambda v: v.column.try_cast("timestamp_ntz") if v.kind == "text" else v.column.cast("timestamp_ntz")
            return cast(a), cast(b)
        if kinds == {"bool", "number"}:
            cast = lambda v: v.column.cast("double")
            return cast(a), cast(b)
        if len(kinds) > 1 and "null" not in kinds:
            raise Unsupported(f"a comparison of {a.kind} with {b.kind}")
        return a.column, b.column


def compile_condition(text: str | None, columns: dict[str, tuple[Column, T.DataType]], strict: bool = False) -> Column:
    """A condition as a Column that is never null; columns: normalised name -> (column, type).

    Blank is true. A missing name is None. What the language doesn't have, and a syntax error, is false, so that
    the cell is left alone; with strict it is an error, which is safer. Text is compared with numbers as a number.
    """
    if not text or not text.strip():
        return F.lit(True)
    try:
        return _Compiler(columns, strict).truth(ast.parse(text.strip(), mode="eval").body)
    except (Unsupported, SyntaxError):
        if strict:
            raise
        return F.lit(False)


def names_in(text: str | None) -> set[str]:
    """The normalised names that a condition reads."""
    try:
        return {normal(n.id) for n in ast.walk(ast.parse((text or "").strip(), mode="eval")) if isinstance(n, ast.Name)}
    except SyntaxError:
        return set()
