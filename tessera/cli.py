"""Command line: ``python -m tessera.cli index|search|repl|stats``."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from tessera import render
from tessera.engine import Engine
from tessera.functions.analysis import Analyzer
from tessera.functions.ranking import Bm25
from tessera.functions.snippet import Highlighter
from tessera.plans.query import QueryError
from tessera.sources.store import StoreError
from tessera.streaming.service import SearchService

DEFAULT = "tessera-index"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    at = {"default": DEFAULT, "metavar": "DIR"}
    x = sub.add_parser("index", help="index a directory tree")
    x.add_argument("path")
    x.add_argument("-i", "--index", **at)
    x.add_argument("--ext", help="comma-separated extensions")
    x.add_argument("--no-stemming", action="store_true")
    x.add_argument("--keep-stopwords", action="store_true")
    x = sub.add_parser("search")
    x.add_argument("query", nargs="+")
    x.add_argument("-i", "--index", **at)
    x.add_argument("--k1", type=float, default=1.2)
    x.add_argument("--b", type=float, default=0.75)
    x.add_argument("--snippet", type=int, default=200)
    x.add_argument("-n", "--limit", type=int, default=10)
    x.add_argument("--json", action="store_true")
    x.add_argument("--explain", action="store_true")
    x = sub.add_parser("repl")
    x.add_argument("-i", "--index", **at)
    x.add_argument("-n", "--limit", type=int, default=5)
    x.add_argument("--watch", metavar="DIR")
    x.add_argument("--every", type=int, default=10)
    x = sub.add_parser("stats")
    x.add_argument("-i", "--index", **at)
    return p.parse_args(argv)


def analyzer(stemming: bool, stopwords: bool) -> Analyzer:
    out = Analyzer().with_stemming(stemming)
    return out if stopwords else out.with_stopwords(())


def _show(engine: Engine, query: str, limit: int, as_json: bool = False, explained: bool = False) -> str:
    began = time.time()
    rows = engine.search(query, limit).collect() if limit > 0 else []
    took = (time.time() - began) * 1000
    stats = engine.searcher().counters(query, limit).first() if as_json or explained else None
    out = render.results_json(query, rows, stats, took) if as_json else render.results(query, rows, render.Style())
    return out + ("\n\n" + render.explain(stats) if explained and not as_json else "")


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    engine = Engine(spark)
    if args.command == "index":
        engine = Engine(spark, analyzer(not args.no_stemming, not args.keep_stopwords))
        if args.ext:
            engine = engine.with_extensions(args.ext.split(","))
        n = engine.index_dir(args.path)
        engine.save(args.index)
        print(f"{n} documents indexed into {args.index}")
    elif args.command == "search":
        engine = engine.with_bm25(Bm25(args.k1, args.b)).with_highlighter(Highlighter().with_max_chars(args.snippet))
        print(_show(engine.load(args.index), " ".join(args.query), args.limit, args.json, args.explain))
    elif args.command == "stats":
        engine.load(args.index)
        print(render.stats(args.index, engine.stats().first(), True))
    else:
        service = SearchService(spark, args.index) if args.watch else None
        stream = None
        if service:
            service.reindex(args.watch)
            stream = service.watch(args.watch, args.every)
        else:
            engine.load(args.index)
        for line in sys.stdin:
            if line.strip() in ("exit", "quit"):
                break
            if line.strip():
                try:
                    print(_show(service.snapshot().engine if service else engine, line.strip(), args.limit), flush=True)
                except QueryError as e:
                    print(f"error: {e}", flush=True)
        if stream:
            stream.stop()
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    try:
        return run(args, spark)
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0
    except (QueryError, StoreError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
