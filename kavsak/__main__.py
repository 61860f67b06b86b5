"""Command line: python -m kavsak COMMAND --option value ..., or the same through spark-submit."""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import DataFrame, SparkSession

from . import commands

COMMANDS = ("match", "normalize", "clean", "knn", "train", "submit", "evaluate", "score", "build")


def parser() -> argparse.ArgumentParser:
    """A sub-command for each function, an option for each of its parameters; those without a default are required."""
    out = argparse.ArgumentParser(prog="kavsak")
    subs = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        f = getattr(commands, name)
        sub = subs.add_parser(name, help=(f.__doc__ or "").strip().split("\n")[0])
        for p in list(inspect.signature(f).parameters.values())[1:]:
            if not isinstance(p.default, str | int | bool | None) and p.default is not p.empty:
                continue
            option = "--" + p.name.replace("_", "-")
            if isinstance(p.default, bool):
                sub.add_argument(option, dest=p.name, action="store_true")
            else:
                kind = int if isinstance(p.default, int) or p.name == "limit" else str
                sub.add_argument(option, dest=p.name, type=kind, required=p.default is p.empty, default=None if p.default is p.empty else p.default)
    return out


def main(args: list[str] | None = None) -> int:
    options = vars(parser().parse_args(args))
    spark = SparkSession.builder.appName("kavsak").getOrCreate()
    got = getattr(commands, options.pop("command"))(spark, **options)
    print({"columns": got.columns} if isinstance(got, DataFrame) else got)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
