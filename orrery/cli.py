"""Command line: search a directory, or index it. Exit status 0 with matches, 1 without, 2 on an error."""

from __future__ import annotations

import argparse
import importlib
import sys

from orrery.contracts import DEFAULT_THRESHOLD, DEFAULT_TOP, DIM, Contract, EngineError
from orrery.engine import Cache, Engine
from orrery.errors import check_query, check_threshold, check_top
from orrery.operators.encode import HashEncoder
from orrery.sources.sinks import render
from orrery.timing import Progress, Timings


def _shared(p: argparse.ArgumentParser) -> None:
    p.add_argument("--index-path", metavar="PATH", help="store the index there instead of inside the directory")
    p.add_argument("--encoder", metavar="MODULE:NAME", help="a callable that returns an encoder")
    p.add_argument("-q", "--quiet", action="store_true", help="no progress, and no header")
    p.add_argument("--timing", action="store_true", help="write the phases' times as JSON to standard error")
    p.add_argument("--timing-file", metavar="PATH", help="with --timing: write them there")
    p.add_argument("--timings", metavar="PATH", help="both in one; - is standard error")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orrery", allow_abbrev=False, description="Search the pictures below a directory.", epilog="'index DIR' brings the index up to date without searching.")
    p.add_argument("words", nargs="*", metavar="[QUERY] DIRECTORY", help="what to find, and where; with --image the directory alone")
    p.add_argument("--image", metavar="FILE", help="find pictures like FILE, which is left out itself")
    p.add_argument("-n", "--top", type=int, default=DEFAULT_TOP, help="number of results")
    p.add_argument("-t", "--threshold", type=float, default=DEFAULT_THRESHOLD, help="least similarity")
    p.add_argument("--reindex", action="store_true", help="embed all pictures again")
    p.add_argument("--no-cache", action="store_true", help="neither read nor write the index")
    p.add_argument("--json", action="store_true")
    p.add_argument("--paths-only", "--paths", dest="paths", action="store_true", help="one path a line")
    p.add_argument("-0", "--null", "--nul", dest="nul", action="store_true", help="paths byte by byte, each ended by NUL")
    _shared(p)
    return p


def index_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orrery index", allow_abbrev=False)
    p.add_argument("directory")
    _shared(p)
    return p


#: Options that exclude each other, by where their values are.
CONFLICTS = [("json", "paths"), ("json", "nul"), ("reindex", "no_cache"), ("index_path", "no_cache"), ("timing", "timings")]


def _numbers(argv: list[str]) -> list[str]:
    """Numbers joined to their options: as there is an option -0, argparse would take -1 for one."""
    names, out, k = {"-n": "--top", "-t": "--threshold", "--top": "--top", "--threshold": "--threshold"}, [], 0
    while k < len(argv):
        if argv[k] in names and k + 1 < len(argv):
            out.append(f"{names[argv[k]]}={argv[k + 1]}")
            k += 1
        else:
            out.append(argv[k])
        k += 1
    return out


def parse(argv: list[str]) -> argparse.Namespace:
    """Arguments with command ("index" or "search"), query, directory and form; SystemExit with status 2 for a wrong line."""
    if argv[:1] == ["index"]:
        p = index_parser()
        args = p.parse_args(argv[1:])
        args.command, args.query, args.image = "index", None, None
    else:
        p = parser()
        end = argv.index("--") if "--" in argv else len(argv)
        args = p.parse_intermixed_args(_numbers(argv[:end]))
        args.words += argv[end + 1 :]
        args.command = "search"
        if args.image is not None and len(args.words) > 1:
            p.error("a text query cannot be combined with --image")
        if len(args.words) != (1 if args.image is not None else 2):
            p.error("give a directory with --image FILE, or a query and a directory")
        *query, args.directory = args.words
        args.query = query[0] if query else None
        args.form = "nul" if args.nul else "json" if args.json else "paths" if args.paths else "text"
    for a, b in CONFLICTS:
        if getattr(args, a, None) and getattr(args, b, None):
            p.error(f"--{a.replace('_', '-')} cannot be combined with --{b.replace('_', '-')}")
    if args.timing_file and not args.timing:
        p.error("--timing-file needs --timing")
    args.report = args.timings or (args.timing_file or "-" if args.timing else None)
    return args


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    try:
        args = parse(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return e.code or 0
    try:
        if args.command == "search":
            check_top(args.top)
            check_threshold(args.threshold)
            if args.query is not None:
                check_query(args.query)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("orrery").getOrCreate()
        module, _, name = (args.encoder or "").partition(":")
        encoder = getattr(importlib.import_module(module), name)() if module else HashEncoder(DIM)
        contract = Contract(args.encoder or "hash-v1", args.encoder or "hash-v1", DIM)
        timings = Timings(args.report is not None)
        engine = Engine(spark, args.directory, encoder, contract, args.index_path, timings=timings, progress=None if args.quiet else Progress())
        if args.command == "index":
            print(f"{engine.index()} images indexed", file=sys.stderr)
            timings.write(args.report)
            return 0
        cache = Cache.REINDEX if args.reindex else Cache.DISABLED if args.no_cache else Cache.USE
        rows = engine.search(args.query, args.image, args.top, args.threshold, cache)
        shown = [(s, args.directory.rstrip("/").encode() + b"/" + p) for s, p in rows]
        try:
            (out or sys.stdout.buffer).write(render(shown, args.form, args.quiet))
        except BrokenPipeError:  # the reader has seen enough
            sys.stdout = None
        timings.write(args.report)
        return 0 if rows else 1
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
