"""python -m plumbline list | run NAME [--sf DIR] [--out PATH] [--rows N] [--fail-if EXPR]

``run`` prints a Markdown table or writes Parquet; with --fail-if it ends with 1 if any row fulfils the SQL expression (a gate)."""

from __future__ import annotations

import argparse
import importlib.util
import sys

from .catalog import core_queries
from .session import build_session
from .sources.records import markdown


def all_queries() -> dict:
    out = core_queries()
    if importlib.util.find_spec("__spark_entry__"):  # with the training-data queries, where they are installed
        out = __import__("__spark_entry__").queries()
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("plumbline")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("--sf", default=".")
    run.add_argument("--out")
    run.add_argument("--rows", type=int, default=50)
    run.add_argument("--fail-if")
    a = p.parse_args(args)
    queries = all_queries()
    if a.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if a.name not in queries:
        print(f"no query {a.name}", file=sys.stderr)
        return 2
    df = queries[a.name](build_session(), a.sf)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
        df = df.sparkSession.read.parquet(a.out)
    else:
        print(markdown(df, a.rows))
    return int(bool(a.fail_if and df.where(a.fail_if).limit(1).count()))


if __name__ == "__main__":
    sys.exit(main())
