"""Command line of the engine: python -m codequarry COMMAND."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from codequarry import reports, service
from codequarry.functions.match import Selector
from codequarry.index import Index
from codequarry.operators import audits
from codequarry.operators.paging import even_sample
from codequarry.sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codequarry", description=__doc__)
    p.add_argument("--master", help="Spark master; by default what the environment sets, else local[*]")
    p.add_argument("--prefix", default="", help="prefix of the index's tables")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("index", help="index source files")
    x.add_argument("root")
    x.add_argument("paths", nargs="+")
    x.add_argument("--min-mass", type=int, default=8)
    for name, value in (("--ecosystem", "local"), ("--name", "local"), ("--release", "0.0.0")):
        x.add_argument(name, default=value)
    x = sub.add_parser("search", help="structural, text or regex search")
    x.add_argument("root")
    x.add_argument("pattern")
    x.add_argument("--contains", action="append", default=[])
    x.add_argument("--not-contains", action="append", default=[])
    x.add_argument("-n", "--limit", type=int, default=20)
    x.add_argument("--skip", type=int, default=0)
    x.add_argument("--text", action="store_true")
    x.add_argument("--regex", action="store_true")
    x = sub.add_parser("query", help="a structured query")
    x.add_argument("root")
    x.add_argument("query")
    x.add_argument("-n", "--limit", type=int, default=service.DSL_ROWS)
    x = sub.add_parser("audit", help="many patterns at once, from a JSON file {check: [pattern, ...]}")
    x.add_argument("root")
    x.add_argument("checks")
    x.add_argument("-n", "--limit", type=int, default=100)
    x.add_argument("--mode", choices=("anchor", "exact"), default="anchor")
    x.add_argument("--most-df", type=int, default=10_000)
    x.add_argument("--group-by", choices=("kind", "check", "package_version_id"))
    x.add_argument("--sample", type=int, help="so many findings at even distances")
    x.add_argument("--save", help="write the findings as JSON lines below this path")
    x.add_argument("--diff", help="findings saved before, to compare with")
    x = sub.add_parser("serve-request", help="answer one request: an endpoint and its JSON parameters")
    x.add_argument("root")
    x.add_argument("endpoint", choices=sorted(service.ENDPOINTS))
    x.add_argument("params", nargs="?", default="{}")
    return p


def _print(rows) -> None:
    for r in rows.collect():  # a page
        print(json.dumps(r.asDict(recursive=True), default=str))


def _audit(index: Index, a) -> None:
    with open(a.checks) as f:
        found = index.audit(json.load(f), mode=a.mode, most_df=a.most_df).drop("id")
    if a.save:
        found.write.mode("overwrite").json(a.save)
    if a.diff:
        before = index.spark.read.schema(found.schema).json(a.diff)
        return _print(audits.diff(before, found, ["check", "kind", "package_version_id", "file", "line", "message"]).groupBy("status").count().orderBy("status"))
    if a.group_by:
        return _print(reports.counts_by(found, a.group_by))
    _print(found.limit(a.limit) if a.sample is None else even_sample(found, ["check", "file", "line", "message"], a.sample))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    builder = SparkSession.builder.appName("codequarry").config("spark.ui.showConsoleProgress", "false")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    if a.command == "index":
        timings = reports.Timings()
        with timings.stage("index"):
            index = Index.build(spark, files.from_paths(spark, a.paths, ecosystem=a.ecosystem, name=a.name, version=a.release), a.root, prefix=a.prefix, min_mass=a.min_mass)
        print(json.dumps({"counts": index.stats(), "kinds": {r["kind"]: r["n"] for r in index.kinds().collect()}, "took": reports.duration(timings.snapshot()["index"]["total"] / 1000)}))
        return 0
    index = Index.open(spark, a.root, prefix=a.prefix)
    if a.command == "search":
        if a.text or a.regex:
            _print((index.search_regex if a.regex else index.search_text)(a.pattern, skip=a.skip, limit=a.limit))
        else:
            _print(index.search(Selector(a.pattern, contains=a.contains, lacks=a.not_contains), skip=a.skip, limit=a.limit))
    elif a.command == "query":
        _print(index.all(a.query, limit=a.limit))
    elif a.command == "audit":
        _audit(index, a)
    else:
        status, body = service.call(index, a.endpoint, json.loads(a.params))
        print(body)
        return 0 if status == 200 else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
