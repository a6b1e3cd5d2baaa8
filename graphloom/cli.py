"""Command line: index a tree and ask about it."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from graphloom.engine import Engine
from graphloom.plans.context import Task


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("--warehouse", default=str(Path.home() / ".graphloom"))
    commands = parser.add_subparsers(dest="command", required=True)
    for name, argument in (("index", None), ("callers", "name"), ("callees", "name"), ("search", "text"), ("symbol", "name"), ("context", "task"), ("gc", None)):
        command = commands.add_parser(name)
        command.add_argument("root")
        if argument:
            command.add_argument("argument", metavar=argument)
    got = parser.parse_args(args)
    project = Engine(spark or SparkSession.builder.getOrCreate(), got.warehouse).attach(got.root)
    if got.command in ("index", "gc"):
        print(project.index() if got.command == "index" else project.collect_garbage())
        return 0
    found = project.find_context(Task(got.argument)) if got.command == "context" else getattr(project, got.command)(got.argument)
    found.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
