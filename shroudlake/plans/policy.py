"""The policy: tables, columns, strategies, consistency groups and global settings."""

from __future__ import annotations

import hashlib
import os
import re
from pathlib import Path
from typing import Any

import yaml
from pydantic import BaseModel, ConfigDict, Field, ValidationError, field_validator, model_validator

_NO_SALT = "the policy needs global.salt: a random text of 32 characters or more"
_VARIABLE = re.compile(r"\$\{(\w+)(?::([^}]*))?\}")


def normal(name: str) -> str:
    """The form of a table or column name in which names are compared."""
    return name.strip().strip('"').strip("`").strip("[]").lower()


class ColumnRule(BaseModel):
    strategy: str
    params: dict[str, Any] = Field(default_factory=dict)
    condition: str | None = None
    condition_sql: str | None = None
    keep_null: bool = True
    consistency_group: str | None = None
    rules: dict[str, Any] | None = None

    @field_validator("strategy")
    @classmethod
    def _lower(cls, v: str) -> str:
        return v.strip().lower()

    @model_validator(mode="after")
    def _rules_to_params(self) -> ColumnRule:
        if self.rules is not None:
            self.params.setdefault("rules", self.rules)
        return self


class TableRule(BaseModel):
    columns: dict[str, ColumnRule] = Field(default_factory=dict)
    where_clause: str | None = None
    truncate: bool = False
    #: Columns that tell rows apart, for noise.
    key: list[str] = Field(default_factory=list)


class ConsistencyGroup(BaseModel):
    name: str
    columns: list[str]
    strategy: str = "deterministic_hash"
    params: dict[str, Any] = Field(default_factory=dict)

    def members(self) -> list[tuple[str, tuple[str, ...]]]:
        """(table, columns) of each entry: `table.column`, or `table.(a, b)` for a composite key."""
        out = []
        for entry in self.columns:
            if m := re.fullmatch(r"\s*(.+?)\.\s*\((.+)\)\s*", entry):
                out.append((normal(m[1].rpartition(".")[2]), tuple(normal(c) for c in m[2].split(","))))
            else:
                table, _, column = entry.rpartition(".")
                out.append((normal(table.rpartition(".")[2]), (normal(column),)))
        return out


class GlobalConfig(BaseModel):
    seed: int | None = 42  # accepted; draws depend on the salt alone
    salt: str
    salt_fingerprint: str | None = None
    locale: str = "en_US"
    batch_size: int = Field(default=5000, ge=1, le=100000)
    cache_pseudonyms: bool = True
    stateless: bool = False
    max_cache_size: int = 500000

    @field_validator("salt")
    @classmethod
    def _not_blank(cls, v: str) -> str:
        if not v.strip():
            raise ValueError(_NO_SALT)
        return v

    def fingerprint(self) -> str:
        return hashlib.sha256(self.salt.strip().encode()).hexdigest()[:16]

    def fingerprint_matches(self) -> bool:
        return not self.salt_fingerprint or self.salt_fingerprint == self.fingerprint()


class Policy(BaseModel):
    model_config = ConfigDict(populate_by_name=True, extra="ignore")

    version: str = "1"
    settings: GlobalConfig = Field(alias="global")
    tables: dict[str, TableRule] = Field(default_factory=dict)
    consistency_groups: list[ConsistencyGroup] = Field(default_factory=list)

    @model_validator(mode="before")
    @classmethod
    def _global_names(cls, data: Any) -> Any:
        if isinstance(data, dict):
            data = dict(data)
            for other in ("global_settings", "settings"):
                if "global" not in data and other in data:
                    data["global"] = data.pop(other)
            given = data.get("global")
            if given is None or isinstance(given, dict) and not str(given.get("salt") or "").strip():
                raise ValueError(_NO_SALT)
        return data

    def table(self, name: str) -> TableRule | None:
        """The rule of a table, whatever the case, quotes and schema of its name."""
        for key, rule in self.tables.items():
            if normal(key) == normal(name):
                return rule
        for key, rule in self.tables.items():
            if normal(key.rpartition(".")[2]) == normal(name.rpartition(".")[2]):
                return rule
        return None

    def group_of(self, table: str, column: str) -> ConsistencyGroup | None:
        """The group that lists a single column."""
        here = (normal(table.rpartition(".")[2]), (normal(column),))
        return next((g for g in self.consistency_groups if here in g.members()), None)

    def composites(self, table: str) -> list[tuple[ConsistencyGroup, tuple[str, ...]]]:
        """The composite keys of a table."""
        name = normal(table.rpartition(".")[2])
        return [(g, cols) for g in self.consistency_groups for t, cols in g.members() if t == name and len(cols) > 1]

    def digest(self) -> str:
        return hashlib.sha256(self.model_dump_json(by_alias=True).encode()).hexdigest()


def interpolate(data: Any) -> Any:
    """${NAME} and ${NAME:default} replaced in all texts; an unset name without default is empty."""
    if isinstance(data, str):
        return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[2] or ""), data)
    if isinstance(data, dict):
        return {k: interpolate(v) for k, v in data.items()}
    return [interpolate(v) for v in data] if isinstance(data, list) else data


def parse_policy(text: str, where: str = "policy") -> Policy:
    """A policy from YAML or JSON; all mistakes are listed in one error."""
    try:
        raw = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"{where} isn't valid YAML: {e}") from e
    try:
        return Policy.model_validate(interpolate(raw))
    except ValidationError as e:
        lines = [f"- {' -> '.join(map(str, x['loc'])) or 'policy'}: {x['msg']}" for x in e.errors()]
        raise ValueError("\n".join([f"{where} isn't a valid policy:", *lines])) from e


def load_policy(path: str | Path) -> Policy:
    return parse_policy(Path(path).read_text(encoding="utf-8"), str(path))


def dump_policy(policy: Policy) -> str:
    return yaml.safe_dump(policy.model_dump(by_alias=True, exclude_none=True), sort_keys=False, allow_unicode=True)


def save_policy(policy: Policy, path: str | Path) -> None:
    """Writes a policy, with the fingerprint of its salt."""
    settings = policy.settings.model_copy(update={"salt_fingerprint": policy.settings.salt_fingerprint or policy.settings.fingerprint()})
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(dump_policy(policy.model_copy(update={"settings": settings})), encoding="utf-8")
