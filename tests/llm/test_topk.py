"""Exact top-k against brute force and SQL."""

import math
import random

import duckdb
import pyarrow as pa
import pytest

from codequarry.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def vectors(n=400, d=8, seed=1, ties=False):
    pick = random.Random(seed)
    return [(i, [pick.choice([-0.5, 0.0, 0.25, 0.5]) if ties else pick.uniform(-1, 1) for _ in range(d)]) for i in range(n)]


def wanted(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: a for i, a in reversed(good) if i % every == 0}.items()):
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def f32(rows):
    """Values as Spark's float column holds them."""
    return [(i, v and [None if x is None else float(pa.scalar(x, pa.float32()).as_py()) for x in v]) for i, v in rows]


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("block", [4096, 3])
def test_equals_brute_force_and_sql(spark, monkeypatch, ties, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "BINS", 16)
    rows = f32(vectors(ties=ties) + [(1000, None), (1050, [None] + [0.1] * 7), (1100, [float("nan")] + [0.1] * 7), (1150, [float("inf")] + [9.0] * 7)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == wanted(rows) and len(got) == 40
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.ORACLE}) ORDER BY ALL").fetchall() == got


def test_few_candidates_other_lengths_repeats_and_null_ids(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0]), (3, []), (50, []), (None, [9.0, 9.0]), (100, [0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", score string, rank int")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == [(0, 1, 1, 256 * 256 * 3), (0, 2, 1, 256 * 256 * 3), (50, 1, 3, 0), (100, 1, 2, 128 * 768)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_huge_and_equal_scores(spark):
    rows = [(0, [1e15, 1e15]), *((i, [1e15, 1e15]) for i in range(9, 0, -1)), (50, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == [(0, r, r, topk.MOST) for r in range(1, 6)] + [(50, r, r - 1, 0) for r in range(1, 6)]


def test_scores_up_to_the_ends_of_a_long_are_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BINS", 64)
    big = 2.0**23
    # scores of query 0 lie close below and above 2**61 and 2**62, or are negative
    rows = [(0, [big, 1.0, -big]), *((i, [2.0**f, i / 256, 0.0]) for i, f in enumerate((22, 23, 22, 22, 21, 23), 1)), (7, [0.0, 0.0, 2.0**23]), (50, [-big, -1.0, big]), (8, [1e308, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in wanted_whole(rows)]
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect())) == want
    assert any(2**61 < abs(s) < 2**63 - 1 for *_, s in want) and want[0][-1] == 2**63 - 1


def wanted_whole(rows):
    whole = lambda x: math.floor(256 * x) if abs(x) < 1e300 else 10**308
    e = [(i, [whole(x) for x in v]) for i, v in rows]
    return [(q, r + 1, i, -s) for q, a in e if q % 50 == 0 for r, (s, i) in enumerate(sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in e if i != q)[:5])]
