"""Command line: python -m tessera --store FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
import time
from collections.abc import Sequence


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--store", required=True, help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)

    def one(name: str, *args: str) -> None:
        command = sub.add_parser(name)
        for a in args:
            command.add_argument(a)

    one("index", "path")
    one("search", "query")
    for name in ("impact", "graph", "twins", "callers", "propagate"):
        one(name, "symbol")
    one("flow", "sink")
    one("context", "path")
    one("neighborhood", "path")
    one("ingest", "path")
    one("ingest-tests", "path")
    one("read", "pointer")
    one("predict")
    one("diagnose")
    audit = sub.add_parser("audit")
    audit.add_argument("rules", help="JSON file: a list of rules with id, pattern, message, severity, path, inside")
    structural = sub.add_parser("structural")
    structural.add_argument("pattern")
    structural.add_argument("--inside", default="")
    structural.add_argument("--has", default="")
    track = sub.add_parser("track")
    for a, kind in (("original_cmd", str), ("input_tokens", int), ("output_tokens", int), ("exec_time_ms", int)):
        track.add_argument(a, type=kind)
    sub.add_parser("critical").add_argument("--limit", type=int, default=20)
    sub.add_parser("map").add_argument("--prefix", default="")
    sub.add_parser("gain").add_argument("--period", default="daily", choices=["summary", "daily", "weekly", "monthly", "commands", "recent"])
    sub.add_parser("verify").add_argument("version", type=int)
    sub.add_parser("condense").add_argument("words", nargs="*")
    return p


def rules_of(path: str) -> list:
    from tessera.operators.parse import ArchRule

    with open(path) as f:
        return [ArchRule(**r) for r in json.load(f)]


def track(w, args) -> None:
    row = (int(time.time() * 1e6), datetime.datetime.now(), args.original_cmd, args.input_tokens, args.output_tokens, args.exec_time_ms)
    w.track(w.spark.createDataFrame([row], "id long, timestamp timestamp, original_cmd string, input_tokens long, output_tokens long, exec_time_ms long"))


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import DataFrame, SparkSession

    from tessera.workspace import Workspace

    spark = spark or SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    w = Workspace(spark, args.store)
    call = {
        "index": lambda: w.index(args.path), "search": lambda: w.search(args.query), "impact": lambda: w.impact(args.symbol), "graph": lambda: w.graph(args.symbol), "twins": lambda: w.twins(args.symbol),
        "callers": lambda: w.callers(args.symbol), "propagate": lambda: w.propagate(args.symbol), "flow": lambda: w.flow(args.sink), "context": lambda: w.context(args.path), "neighborhood": lambda: w.neighborhood(args.path),
        "ingest": lambda: w.ingest(args.path), "ingest-tests": lambda: w.ingest_tests(args.path), "read": lambda: w.read(args.pointer), "predict": lambda: w.predict(sys.stdin.read()), "critical": lambda: w.critical(args.limit),
        "diagnose": lambda: w.diagnose(sys.stdin.read()), "audit": lambda: w.audit(rules_of(args.rules)), "structural": lambda: w.structural(args.pattern, args.inside, args.has), "track": lambda: track(w, args),
        "map": lambda: w.map(args.prefix), "gain": lambda: w.gain(args.period), "verify": lambda: w.verify(args.version), "condense": lambda: "\n".join(w.condense(sys.stdin.read(), args.words)),
    }
    try:
        result = call[args.command]()
    except LookupError as e:
        print(e, file=sys.stderr)
        return 1
    for r in result if isinstance(result, tuple) else (result,):
        if isinstance(r, DataFrame):
            r.show(200, truncate=False)
            if args.command == "audit" and r.where("severity = 'error'").count():
                return 1
        elif r is not None:
            print(r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
