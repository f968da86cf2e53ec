"""The strategies: functions from (column, type, context, parameters) to a column, by name and alias."""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crypto import canon

#: Where other packages announce strategies.
PLUGINS = "shroudlake.strategies"
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class MaskContext:
    """What a strategy knows when an expression is built; nothing of it exists for each row."""

    table: str = ""
    column: str = ""
    salt: str = ""
    locale: str = "en_US"
    group: str | None = None
    nonce: Column | None = None
    keep_null: bool = True

    @property
    def scope(self) -> str:
        """What keys and draws are bound to: the group, else table and column."""
        return f"group:{self.group}" if self.group else f"{self.table}.{self.column}"

    @property
    def prefix(self) -> str:
        """The secret text in front of a value in draws."""
        return f"{self.salt}\x1f{self.scope}\x1f"


Build = Callable[..., Column]


@dataclass(frozen=True)
class Strategy:
    name: str
    build: Build
    aliases: tuple[str, ...] = ()
    description: str = ""
    presets: dict[str, dict[str, Any]] = field(default_factory=dict)

    @property
    def null_safe(self) -> bool:
        """Whether null is known to give null, so that no test for it is needed around the expression."""
        return self.build.__module__.startswith(__package__)

    def parameters(self) -> set[str]:
        return {p.name for p in inspect.signature(self.build).parameters.values() if p.kind is p.KEYWORD_ONLY}


_STRATEGIES: dict[str, Strategy] = {}
_ALIASES: dict[str, str] = {}
_loaded = False


def register(name: str, *aliases: str, presets: dict[str, dict[str, Any]] | None = None) -> Callable[[Build], Build]:
    """Registers a builder: build(column, type, context, *, parameters) -> column. presets: parameters by alias."""

    def wrap(build: Build) -> Build:
        _STRATEGIES[name] = Strategy(name, build, aliases, (build.__doc__ or "").strip().split("\n")[0], presets or {})
        _ALIASES.update({a: name for a in aliases})
        return build

    return wrap


def register_function(name: str, function: Callable[[Any], Any], returns: str = "string") -> None:
    """Registers a Python function of one value; it runs in Arrow batches, and nulls don't reach it."""

    def batch(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    run = F.pandas_udf(batch, returns)

    def build(c: Column, kind: T.DataType, ctx: MaskContext) -> Column:
        return run(c)

    build.__doc__ = function.__doc__
    register(name)(build)


def _load_plugins() -> None:
    global _loaded
    if _loaded:
        return
    _loaded = True
    for point in entry_points(group=PLUGINS):
        try:
            point.load()
        except Exception:  # a broken plugin must not stop the others
            log.exception("strategy plugin %s can't be loaded", point.name)


def lookup(name: str) -> tuple[Strategy, dict[str, Any]]:
    """The strategy of a name or alias, and the parameters that the alias sets."""
    _load_plugins()
    key = name.strip().lower()
    strategy = _STRATEGIES.get(_ALIASES.get(key, key))
    if strategy is None:
        raise KeyError(f"unknown strategy {name!r}; there are {', '.join(sorted(_STRATEGIES))}")
    return strategy, strategy.presets.get(key, {})


def strategies() -> list[Strategy]:
    _load_plugins()
    return [_STRATEGIES[k] for k in sorted(_STRATEGIES)]


def build(name: str, c: Column, kind: T.DataType, ctx: MaskContext, params: dict[str, Any] | None = None) -> Column:
    """The masked column. Parameters that the strategy doesn't have are an error."""
    strategy, preset = lookup(name)
    given = preset | (params or {})
    if unknown := set(given) - strategy.parameters():
        raise ValueError(f"{strategy.name} has no parameter {', '.join(sorted(unknown))}; it has {', '.join(sorted(strategy.parameters()))}")
    return strategy.build(c, kind, ctx, **given)


def text_of(c: Column, kind: T.DataType) -> Column:
    return canon(c, kind)
