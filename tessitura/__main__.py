"""python -m tessitura list|hash [options] PATH...: the commands on one machine's files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.run import ALGORITHMS, FORMATS, choice, json_array, last_warnings, plain, run, status, suppressed
from .plans.diagnostics import PredicateError
from .sources.discover import PathError


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("tessitura")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("list", "hash"):
        p = commands.add_parser(name)
        p.add_argument("paths", nargs="+")
        p.add_argument("-o", "--output", "--format", dest="format", default="")
        p.add_argument("--no-warn", nargs="?", const="")
        p.add_argument("--strict", "--strict-exit-code", dest="strict", action="store_true")
        if name == "list":
            p.add_argument("--filter")
        else:
            p.add_argument("-a", "--algorithm", default="")
    given = parser.parse_args(args)
    try:
        style, silent = choice(given.format, FORMATS), suppressed(given.no_warn)
        algorithm = choice(given.algorithm, ALGORITHMS) if given.command == "hash" else None
        spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
        done = run(spark, given.paths, getattr(given, "filter", None), algorithm, silent)
    except (PredicateError, PathError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    done.files.persist()
    rows, counts = done.rows, done.counts.first()
    if style == "json":
        for piece in json_array(rows, algorithm):
            sys.stdout.write(piece)
    else:
        for r in plain(rows, algorithm).toLocalIterator():
            print(r["line"])
    said = [(p, "file", m) for p, m in done.walked if "file" not in silent] + [tuple(r) for r in done.warnings.toLocalIterator()]
    for path, category, message in [*said, *(("", c, m) for c, m in last_warnings(counts, silent))]:
        print(f"{category}: {path + ': ' if path else ''}{message}", file=sys.stderr)
    done.files.unpersist()
    return status(counts, done.walked, silent, given.strict)


if __name__ == "__main__":
    sys.exit(main())
