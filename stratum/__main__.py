"""python -m stratum: analyse, relate, compare, database, init, clean."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .errors import SizeLimit, StratumError
from .operators.ledger import NoSourceBytes
from .plans import analysis, render, state
from .sources.repository import fetch_snapshot


def fetch(url: str, most: int = 64 << 20) -> bytes:
    """Over HTTPS; one byte more than ``most`` at most, and nothing where the answer says that it is longer."""
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as r:  # noqa: S310
        if int(r.headers.get("Content-Length") or 0) > most:
            raise SizeLimit(f"{url}: more than {most} bytes")
        return r.read(most + 1)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratum")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse", help="a tree, a file, or a repository's address")
    a.add_argument("path")
    a.add_argument("--ledger-only", action="store_true")
    a.add_argument("--granularity", choices=["repository", "file", "function"], default="repository")
    r = sub.add_parser("relate", help="two files of one tree")
    r.add_argument("root")
    r.add_argument("first")
    r.add_argument("second")
    c = sub.add_parser("compare", help="two repositories")
    c.add_argument("first")
    c.add_argument("second")
    c.add_argument("--granularity", choices=["repository", "file", "function"], default="repository")
    b = sub.add_parser("database", help="build from a manifest, or update from a release")
    b.add_argument("action", choices=["build", "update"])
    b.add_argument("manifest", nargs="?")
    b.add_argument("--output", required=True)
    b.add_argument("--tag")
    for name in ("init", "clean"):
        q = sub.add_parser(name)
        q.add_argument("path", nargs="?", default=".")
        q.add_argument("--force", action="store_true")
    for q in (a, r, c):
        q.add_argument("--format", choices=["text", "json"], default="text")
    return p


def run(spark: SparkSession, argv: list[str], get=fetch) -> str:
    """The text that a command prints."""
    o = parser().parse_args(argv)
    show = lambda value, text: state.pretty(value).decode() if o.format == "json" else text(value)
    match o.command:
        case "analyse":
            files, functions = o.granularity == "file" or o.granularity == "function", o.granularity == "function"
            if o.ledger_only and (files or state.is_remote(o.path)):
                raise StratumError("--ledger-only goes with a local path and no granularity")
            if state.is_remote(o.path):
                return show(analysis.analyse_snapshot(spark, fetch_snapshot(o.path, get), files, functions), render.repository)
            if files:
                return show(analysis.granular_path(spark, o.path, files, functions), render.granular)
            return show(analysis.analyse_path(spark, o.path, profile=not o.ledger_only), render.analysis)
        case "relate":
            return show(analysis.relate_paths(spark, o.root, o.first, o.second), render.relation)
        case "compare":
            if o.granularity == "file":
                raise StratumError("repositories compare as a whole or by function")
            pair = [fetch_snapshot(x, get) for x in (o.first, o.second)]
            return show(analysis.compare_snapshots(spark, *pair, o.granularity == "function"), render.comparison)
        case "database":
            if o.action == "build":
                made = state.build_database(spark, o.manifest, o.output, get)
            else:
                made = state.update_database(get, o.output, o.tag)
            return f"{len(made['projects'])} projects\n"
        case "init":
            made, hit = state.initialise(spark, o.path, o.force)
            return render.analysis(made) + f"cache: {'hit' if hit else 'miss'}\n"
        case _:
            state.clean(o.path, o.force)
            return "removed\n"


def main() -> int:
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        sys.stdout.write(run(spark, sys.argv[1:]))
    except (StratumError, NoSourceBytes, json.JSONDecodeError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
