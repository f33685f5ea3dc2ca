"""Reports of runs: outcomes of packages, timings of stages, findings by group."""

from __future__ import annotations

import time
from collections.abc import Sequence
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duration(seconds: float) -> str:
    """42s, 3m07s or 2h05m."""
    s = round(seconds)
    if seconds < 60:
        return f"{s}s"
    return f"{s // 60}m{s % 60:02d}s" if seconds < 3600 else f"{s // 3600}h{s % 3600 // 60:02d}m"


class Timings:
    """Count, total, mean and greatest of each stage's milliseconds, and of counters."""

    def __init__(self):
        self._seen: dict[str, list[float]] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.add(name, 1000 * (time.monotonic() - began))

    def add(self, name: str, amount: float) -> None:
        n, total, most = self._seen.get(name, [0, 0.0, float("-inf")])
        self._seen[name] = [n + 1, total + amount, max(most, amount)]

    def snapshot(self) -> dict[str, dict]:
        return {k: {"count": n, "total": round(total), "avg": round(total / n), "max": round(most)} for k, (n, total, most) in sorted(self._seen.items())}


def run_report(outcomes: DataFrame, elapsed_ms: int, options: dict | None = None, most_failures: int = 10_000) -> dict:
    """ok, skipped and error counts and the failures of outcomes (name, version, status, reason).

    At most most_failures are listed; failures_total says how many there are.
    """
    counts = {r["status"]: r["count"] for r in outcomes.groupBy("status").count().collect()}
    failed = outcomes.where("status = 'error'").select("name", "version", "reason").orderBy("name", "version").limit(most_failures)
    return {
        "generated_at": datetime.now(UTC).isoformat(), "elapsed_ms": elapsed_ms, **{k: counts.get(k, 0) for k in ("ok", "skipped", "error")},
        "failures": [r.asDict() for r in failed.collect()], "failures_total": counts.get("error", 0), "options": options or {},
    }


def merged(reports: Sequence[dict]) -> dict:
    """Reports of parts of a run as one."""
    return {k: sum(r[k] for r in reports) for k in ("ok", "skipped", "error")} | {"failures": [f for r in reports for f in r["failures"]]}


def missing_tarballs(entries: DataFrame, tarballs: DataFrame) -> DataFrame:
    """Entries (name, version) for which no tarball (name, version) is there."""
    return entries.join(tarballs.select("name", "version"), ["name", "version"], "left_anti")


def counts_by(findings: DataFrame, column: str) -> DataFrame:
    """Findings by kind, check or package: most first, then by value."""
    return findings.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_last())


def outcomes_by(outcomes: DataFrame, part: str, status: str = "status") -> DataFrame:
    """ok, skipped and error counts of each part of a run, one row a part."""
    n = lambda s: F.count(F.when(F.col(status) == s, 1)).alias(s)
    return outcomes.groupBy(part).agg(n("ok"), n("skipped"), n("error"))


def timings_by(rows: DataFrame, stage: str, value: str) -> DataFrame:
    """Calls, total, mean and most of a value by stage."""
    v = F.col(value)
    return rows.groupBy(stage).agg(F.count("*").alias("calls"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("most"))


def numbered_hits(hits: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Hits with their number within their group from 1: a grouping for display that gathers no group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return hits.withColumn("number", F.row_number().over(w).cast("long"))


def fingerprint_by(rows: DataFrame, group: str, key: str, sha: str, block: int = 1000) -> DataFrame:
    """A digest of each group's keys and hashes: SHA-256 over blocks of consecutive keys, and over the blocks' digests in order.

    key: a whole number, unique in its group. Only block digests of a group meet in one place.
    """
    line = F.concat(F.col(key).cast("string"), F.lit(":"), F.col(sha))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]), "\n"), 256)
    blocks = rows.groupBy(group, F.floor(F.col(key) / block).alias("b")).agg(joined(F.struct(F.col(key).alias("k"), line.alias("v"))).alias("d"), F.count("*").alias("n"))
    return blocks.groupBy(group).agg(joined(F.struct(F.col("b").alias("k"), F.col("d").alias("v"))).alias("fingerprint"), F.sum("n").alias("files"))


def grouped_hits(hits: DataFrame, keys: Sequence[str] = ("package", "version", "path")) -> DataFrame:
    """One row a file with its hits in order of lines. For a page of hits: each group is gathered."""
    rest = [c for c in hits.columns if c not in keys]
    lines = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in (["line"] if "line" in rest else []) + [c for c in rest if c != "line"]])))
    return hits.groupBy(*keys).agg(lines.alias("hits")).orderBy(*keys)
