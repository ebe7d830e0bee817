"""The command line: ``python -m epochgraph.cli --db DUMP QUERY...``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time
import webbrowser
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import counts, prepare, query, render
from .sources import dump

log = logging.getLogger("epochgraph")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="epochgraph", description="How many packages depended on others, at every time.")
    p.add_argument("--db", default="./db-dump.tar.gz", metavar="PATH", help="the registry's dump, a folder of its tables, or a folder that --save has written")
    p.add_argument("--exclude", action="append", default=[], metavar="REGEX", help=argparse.SUPPRESS)
    p.add_argument("--jobs", "-j", type=int, default=min(os.cpu_count() or 1, 32), metavar="N", help="threads of a local run [default: %(default)s]")
    p.add_argument("--relative", action="store_true", help="as a fraction of all packages, not a number")
    p.add_argument("--title", help=argparse.SUPPRESS)
    p.add_argument("--transitive", action="store_true", help="count transitive dependencies too, not just direct ones")
    p.add_argument("--save", metavar="FOLDER", help="also write the prepared tables as Parquet")
    p.add_argument("--lines", metavar="FOLDER", help="also write the lines as text files, in parallel")
    p.add_argument("--open", action="store_true", help="open the chart in a browser")
    p.add_argument("queries", nargs="+", metavar="QUERIES", type=_query)
    return p


def _query(text: str) -> str:
    try:
        return query.check(text)
    except query.QueryError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if args[:1] == ["epochgraph"]:  # so that it can be a subcommand
        args = args[1:]
    opt = parser().parse_args(args)
    if not os.path.exists(opt.db) and "://" not in opt.db:
        print(f"Database dump does not exist: {opt.db}", file=sys.stderr)
        return 1
    logging.basicConfig(level=logging.INFO if sys.stderr.isatty() else logging.WARNING)
    spark = spark or SparkSession.builder.master(f"local[{opt.jobs}]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(max(8, opt.jobs))).getOrCreate()
    for pattern in opt.exclude:
        if wrong := prepare.pattern_error(spark, pattern):
            print(f"wrong pattern {pattern!r}: {wrong}", file=sys.stderr)
            return 2
    began = time.monotonic()
    saved = dump._exists(spark, f"{opt.db}/packages.parquet")
    registry = dump.open_saved(spark, opt.db) if saved else dump.load(spark, opt.db)
    if opt.save:
        dump.save(registry, opt.save)
        registry = dump.open_saved(spark, opt.save)
    log.info("load time: %.2f s", time.monotonic() - began)
    began = time.monotonic()
    try:
        found = counts.over_time(registry, opt.queries, opt.transitive, opt.exclude, opt.relative).persist()
        terminal = sys.stdout.isatty()
    except query.QueryError as e:
        print(e, file=sys.stderr)
        return 1
    printed = 0
    for line in counts.lines(found, len(opt.queries), opt.relative, head=10 if terminal else None):
        print(line)
        printed += 1
    log.info("query time: %.2f s", time.monotonic() - began)
    if opt.lines:
        counts.write_lines(found, len(opt.queries), opt.lines, opt.relative)
    if terminal or opt.open:
        if not printed:
            print("zero results", file=sys.stderr)
        else:
            releases = prepare.exclude(registry, opt.exclude).releases if opt.relative else None
            path = render.write(found.select("ts", "query_id", "value"), query.labels(registry, opt.queries), opt.transitive, opt.title, releases)
            print(f"chart written to {path}", file=sys.stderr)
            if opt.open:
                webbrowser.open(path.as_uri())
    return 0


if __name__ == "__main__":
    sys.exit(main())
