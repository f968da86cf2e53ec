"""The command line: python -m shroudlake COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import __version__, audit
from .operators import discovery, metrics
from .operators.compare import policy_diff, preview
from .operators.integrity import foreign_keys, groups_of
from .operators.masking import mask, observed
from .operators.registry import strategies
from .operators.subset import subset, subset_stats
from .plans.policy import dump_policy, load_policy, save_policy
from .sources.database import read_jdbc
from .sources.files import dry_run, format_of, read_table, table_of, write_table
from .sources.sqldump import dump_tables, mask_dump, read_dump


def _tables(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """The tables of the input: of a dump, of a database table, or of one file."""
    if args.input.startswith("jdbc:"):
        return {args.table: read_jdbc(spark, args.input, args.table)}
    if format_of(args.input) == "sql":
        return dump_tables(read_dump(spark, args.input))
    return {args.table or table_of(args.input): read_table(spark, args.input)}


def _say(rows: DataFrame) -> None:
    for r in rows.collect():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def do_mask(spark: SparkSession, args: argparse.Namespace) -> int:
    policy = load_policy(args.config)
    audit.check_policy(policy, args.allow_weak_salt, args.allow_other_salt)
    options = {"since": args.since, "since_column": args.since_column, "strict": args.strict}
    start, counts = time.monotonic(), {"rows": 0, "cells": 0}
    if format_of(args.input) == "sql":
        if args.output is None:
            raise SystemExit("a dump needs --output")
        mask_dump(spark, args.input, args.output, policy, **options)
    else:
        ((name, df),) = _tables(spark, args).items()
        if policy.table(name) is None and not policy.composites(name):
            raise SystemExit(f"the policy has no rule for table {name}; give --table")
        out, seen = observed(df, name, policy, **options)
        if args.dry_run or args.output is None:
            dry_run(out)
        else:
            write_table(out, args.output, mode="overwrite" if args.overwrite else "error")
        rule = policy.table(name)
        counts = seen.get if rule is None or not rule.truncate else counts
    if args.audit:
        record = audit.audit_record(policy, args.input, args.output, counts | {"elapsed_seconds": round(time.monotonic() - start, 3)}, tags=args.tag)
        Path(args.audit).write_text(json.dumps(record, indent=1), encoding="utf-8")
    print(json.dumps(counts))
    return 0


def do_scan(spark: SparkSession, args: argparse.Namespace) -> int:
    found = [d for name, df in _tables(spark, args).items() for d in discovery.scan(df, name)]
    groups = []
    if format_of(args.input) == "sql":
        ddl = read_dump(spark, args.input).where("kind = 'other'").select("text")
        groups = groups_of(foreign_keys("\n".join(r.text for r in ddl.collect())))  # definitions, not data
    if args.output:
        save_policy(discovery.generate_policy(found, groups), args.output)
    for d in found:
        print(json.dumps(vars(d)))
    return 0


def do_verify(spark: SparkSession, args: argparse.Namespace) -> int:
    found = discovery.verify(_tables(spark, args))
    for d in found:
        print(json.dumps(vars(d)))
    return int(bool(found))


def do_lint(spark: SparkSession, args: argparse.Namespace) -> int:
    drift = discovery.lint(_tables(spark, args), load_policy(args.config))
    print(json.dumps({"unmapped": [f"{d.table}.{d.column}" for d in drift.unmapped], "unknown_tables": drift.unknown_tables, "missing_tables": drift.missing_tables}))
    return int(drift.fails(args.strict))


def do_evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    ((_, df),) = _tables(spark, args).items()
    df = df.limit(args.limit) if args.limit else df
    row = metrics.evaluate(df, args.quasi_identifiers.split(","), args.sensitive, args.k, args.l).first()
    print(json.dumps(row.asDict(), default=float))
    return int(not row.compliant)


def do_subset(spark: SparkSession, args: argparse.Namespace) -> int:
    pieces = read_dump(spark, args.input)
    before = dump_tables(pieces)
    ddl = pieces.where("kind = 'other'").select("text")
    after = subset(before, foreign_keys("\n".join(r.text for r in ddl.collect())), args.root, args.limit, args.where, upstream=args.upstream)
    for name, df in after.items():
        write_table(df, f"{args.output.rstrip('/')}/{name}.parquet")
    _say(subset_stats(before, after))
    return 0


def do_preview(spark: SparkSession, args: argparse.Namespace) -> int:
    ((name, df),) = _tables(spark, args).items()
    _say(preview(df, name, load_policy(args.config), args.rows))
    return 0


def do_diff(spark: SparkSession, args: argparse.Namespace) -> int:
    ((name, df),) = _tables(spark, args).items()
    _say(policy_diff(df, name, load_policy(args.config), load_policy(args.other)))
    return 0


def do_bench(spark: SparkSession, args: argparse.Namespace) -> int:
    ((name, df),) = _tables(spark, args).items()
    policy, start = load_policy(args.config), time.monotonic()
    dry_run(mask(df, name, policy))
    seconds = time.monotonic() - start
    print(json.dumps({"rows": (n := df.count()), "seconds": round(seconds, 3), "rows_per_s": round(n / seconds)}))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shroudlake", description="Data anonymisation on Spark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: object, *options: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("-i", "--input", required=True)
        c.add_argument("--table")
        if "config" in options:
            c.add_argument("-c", "--config", required=True)
        if "output" in options:
            c.add_argument("-o", "--output", required="needs output" in options)
        return c

    c = command("mask", do_mask, "config", "output")
    c.add_argument("--since")
    c.add_argument("--since-column")
    c.add_argument("--audit")
    c.add_argument("--tag", action="append", help="what the run is for; goes into the audit record")
    for flag in ("--dry-run", "--overwrite", "--strict", "--allow-weak-salt", "--allow-other-salt"):
        c.add_argument(flag, action="store_true")
    command("scan", do_scan, "output")
    command("verify", do_verify)
    command("lint", do_lint, "config").add_argument("--strict", action="store_true")
    c = command("evaluate", do_evaluate)
    c.add_argument("-q", "--quasi-identifiers", required=True)
    c.add_argument("-s", "--sensitive")
    c.add_argument("-k", type=int, default=5)
    c.add_argument("-l", type=int, default=2)
    c.add_argument("--limit", type=int)
    c = command("subset", do_subset, "output", "needs output")
    c.add_argument("--root", required=True)
    c.add_argument("--limit", type=int)
    c.add_argument("--where")
    c.add_argument("--upstream", action="store_true")
    command("preview", do_preview, "config").add_argument("--rows", type=int, default=5)
    command("diff", do_diff, "config").add_argument("--other", required=True)
    command("bench", do_bench, "config")
    sub.add_parser("strategies")
    sub.add_parser("version")
    c = sub.add_parser("init")
    c.add_argument("-o", "--output", required=True)
    c = sub.add_parser("audit-verify")
    c.add_argument("record")
    c.add_argument("--key-variable", default="AUDIT_KEY", help="the environment variable that holds the key")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "strategies":
        for s in strategies():
            print(f"{s.name} ({', '.join(s.aliases)}): {s.description}" if s.aliases else f"{s.name}: {s.description}")
        return 0
    if args.command == "init":
        policy = discovery.generate_policy([])
        Path(args.output).write_text(dump_policy(policy), encoding="utf-8")
        return 0
    if args.command == "audit-verify":
        good = audit.verify_record(json.loads(Path(args.record).read_text(encoding="utf-8")), audit.secret(args.key_variable))
        print("valid" if good else "not valid")
        return int(not good)
    spark = spark or SparkSession.builder.appName("shroudlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
