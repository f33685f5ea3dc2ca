"""Order, pages, cursors, ranks, bounded counts and even samples."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The largest limit there is, which asks for every row.
EVERY = 2**31 - 1
#: Bound below which a candidate count is exact.
MAX_CANDIDATES = 10_000
KIND_RANK = {"def": 0, "defp": 1, "defmacro": 2, "defmacrop": 3, "module": 6, "expression": 9}


def after(keys: Sequence[str], cursor: Sequence) -> Column:
    """Rows behind a cursor in ascending order of keys, as comparisons that reach the scan."""
    out = F.lit(False)
    for i in reversed(range(len(keys))):
        out = (F.col(keys[i]) > cursor[i]) | ((F.col(keys[i]) == cursor[i]) & out) if i < len(keys) - 1 else F.col(keys[i]) > cursor[i]
    return out


def keyset_page(df: DataFrame, keys: Sequence[str], limit: int, cursor: Sequence | None = None) -> DataFrame:
    """The next rows behind the cursor. keys must end in a unique one."""
    rows = df if cursor is None else df.where(after(keys, cursor))
    return rows.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(limit)


def offset_page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def encode_cursor(*values) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode().rstrip("=")


def decode_cursor(text: str | None) -> list:
    """The cursor's values; a malformed cursor is the beginning."""
    try:
        found = json.loads(base64.urlsafe_b64decode((text or "") + "=" * (-len(text or "") % 4)))
        return found if isinstance(found, list) else [0]
    except (ValueError, TypeError):
        return [0]


def kind_rank(kind: Column) -> Column:
    out = F.lit(8)
    for k, r in KIND_RANK.items():
        out = F.when(kind == k, r).otherwise(out)
    return out


def path_rank(path: Column) -> Column:
    return (
        F.when(path.isNull(), 9).when(path.contains("/lib/") | path.startswith("lib/"), 0).when(path.contains("/src/") | path.startswith("src/"), 1)
        .when(path.contains("/test/") | path.startswith("test/"), 5).when(path.contains("/bench") | path.startswith("bench"), 6)
        .when(path.endswith(".exs"), 7).when(path.endswith(".ex"), 2).otherwise(4)
    )


def ranked(df: DataFrame, *, score: str = "score", kind: str = "kind", path: str = "path", line: str = "line", id_: str = "id", skip: int = 0, limit: int = 50) -> DataFrame:
    """The best hits over all shards at once: score, kind, place of the path, path, line, id."""
    return df.orderBy(
        F.col(score).desc_nulls_last(), kind_rank(F.col(kind)), path_rank(F.col(path)), F.col(path).asc_nulls_last(), F.col(line).asc_nulls_last(), F.col(id_).asc_nulls_last()
    ).offset(skip).limit(limit)


def bounded_count(df: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """One row: value, and "eq", or "gte" if there are more than most."""
    n = df.limit(most + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(most)).cast("long").alias("value"), F.when(F.col("n") > most, "gte").otherwise("eq").alias("relation"))


def even_sample(df: DataFrame, keys: Sequence[str], count: int, buckets: int = 64) -> DataFrame:
    """count rows at even distances in the order of keys, first and last among them; all rows if there are no more.

    keys must end in a unique one. Rows fall into ranges of the first key whose bounds are constants
    taken from a bounded sample, so no task gets all rows and a repeated task gives the same.
    """
    n = df.count()
    if n <= count:
        return df
    if count <= 0:
        return df.limit(0)
    wanted = sorted({round(i * (n - 1) / (count - 1)) for i in range(count)} if count > 1 else {0})
    k, order = F.col(keys[0]), [F.col(x).asc_nulls_last() for x in keys]
    some = sorted(r[0] for r in df.where(k.isNotNull()).select(k).distinct().orderBy(F.xxhash64(k)).limit(32 * buckets).collect())
    bounds = sorted({some[i * len(some) // buckets] for i in range(1, buckets)}) if some else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= k)) if bounds else F.lit(0)
    dealt = df.withColumn("__cq_part", F.when(k.isNull(), len(bounds) + 1).otherwise(part))
    sizes = {r["__cq_part"]: r["count"] for r in dealt.groupBy("__cq_part").count().collect()}
    begin, starts = 0, {}
    for p in sorted(sizes):
        starts[p] = begin
        begin += sizes[p]
    local = dealt.withColumn("__cq_rn", F.row_number().over(Window.partitionBy("__cq_part").orderBy(*order)))
    picks = [(p, w - s + 1) for w in wanted for p, s in starts.items() if s <= w < s + sizes[p]]
    chosen = df.sparkSession.createDataFrame(picks, "__cq_part int, __cq_rn int")
    return local.join(F.broadcast(chosen), ["__cq_part", "__cq_rn"], "left_semi").drop("__cq_part", "__cq_rn")


def page(rows: DataFrame, skip: int, limit: int) -> DataFrame:
    """limit rows after the first skip of ordered ones. Whoever takes all of them, by EVERY, leaves them in their ranges rather than in one task."""
    rows = rows.offset(skip) if skip else rows
    return rows if limit >= EVERY else rows.limit(limit)
