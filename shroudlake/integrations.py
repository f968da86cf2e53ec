"""Thin wrappers for continuous integration, schedulers and logs."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterable
from datetime import UTC, datetime
from typing import Any

from .operators.discovery import Detection


def annotations(found: Iterable[Detection]) -> list[str]:
    """Workflow commands that show findings as errors of a run."""
    clean = lambda s: s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    return [f"::error title=Personal data in {clean(d.table)}.{clean(d.column)}::{clean(d.pii_type)} ({clean(d.reason)})" for d in found]


def step_summary(title: str, values: dict[str, Any]) -> str:
    """A table in Markdown, also written to the file that the run names for summaries."""
    text = "\n".join([f"### {title}", "", "| | |", "|-|-|", *(f"| {k} | {v} |" for k, v in values.items()), ""])
    if path := os.environ.get("GITHUB_STEP_SUMMARY"):
        with open(path, "a", encoding="utf-8") as f:
            f.write(text + "\n")
    return text


class JsonLines(logging.Formatter):
    """Log records as JSON, one on a line."""

    def format(self, record: logging.LogRecord) -> str:
        data = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            data["exception"] = self.formatException(record.exc_info)
        return json.dumps(data, ensure_ascii=False)


def mask_task(arguments: list[str], verify: bool = True) -> int:
    """What a scheduler's task runs: the mask command, then a leak audit of what it wrote."""
    from .cli import main

    code = main(["mask", *arguments])
    if code == 0 and verify and "--dry-run" not in arguments:
        for flag in ("-o", "--output"):
            if flag in arguments:
                return main(["verify", "-i", arguments[arguments.index(flag) + 1]])
    return code


def airflow_operator() -> type:
    """An operator class for Airflow, where that is installed."""
    from airflow.models import BaseOperator

    class MaskOperator(BaseOperator):
        template_fields = ("arguments",)

        def __init__(self, *, arguments: list[str], verify: bool = True, **kwargs: Any):
            super().__init__(**kwargs)
            self.arguments, self.verify = arguments, verify

        def execute(self, context: Any) -> None:
            if mask_task(list(self.arguments), self.verify):
                raise RuntimeError("masking or its leak audit failed")

    return MaskOperator
