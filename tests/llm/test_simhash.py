"""SimHash near-dedup against brute force."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from codequarry.llm import simhash
from codequarry.llm.components import connected_components

SCHEMA = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(500)]


def texts(n, seed=1):
    """Documents with copies, near copies in chains, and odd ones."""
    pick = random.Random(seed)
    out = [None, "", "  \t\n", "one", "one two three", "One TWO three four", "Ünïcode wörds hier und da", "a\x85b c\u00a0d e f"]
    while len(out) < n:
        t = [pick.choice(WORDS) for _ in range(pick.randint(1, 400))]
        out.append(" ".join(t))
        for _ in range(pick.randint(0, 4)):
            t = list(t)
            t[pick.randrange(len(t))] = pick.choice(WORDS)
            out.append(" ".join(t))
    return out[:n]


def test_fingerprints_are_the_contracts():
    some = texts(120)
    got = simhash.fingerprints(pa.array(some, pa.string()))
    assert got.tolist() == [brute.fingerprint(t) for t in some]


def test_a_very_long_text():
    text = " ".join(WORDS[i * 7 % 500] for i in range(30_000))
    assert int(simhash.fingerprints(pa.array([text]))[0]) == brute.fingerprint(text)


def test_components_equal_brute_force(spark):
    rows = list(enumerate(texts(300, 2)))
    rows += [(1000 + i, t) for i, t in rows[::7]]  # exact copies
    random.Random(3).shuffle(rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    prints = sorted((i, brute.fingerprint(t)) for i, t in rows)
    want = brute.components(prints)
    assert got == {i: (f"{x:016x}", want[i]) for i, x in prints}
    assert len({c for _, c in got.values()}) < len(rows) - 40


@pytest.mark.parametrize("block", [4, 1024])
def test_links_find_all_that_brute_force_finds(spark, monkeypatch, block):
    """Prints with few and many differing bits, many of them under one key, whether in one block or in pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    pick, prints = random.Random(5), set()
    for _ in range(12):
        x = pick.getrandbits(64)
        prints.add(x)
        for n in (1, 2, 3, 4, 4, 4, 5, 6):
            y = x
            for b in pick.sample(range(64), n):
                y ^= 1 << b
            prints.add(y)
    base = pick.getrandbits(64)
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(40, 64, 3) for b in range(41, 64, 4)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x, 0) for x in signed], "fp long, first long"))
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    want = brute.components([(x, x & (2**64 - 1)) for x in signed])
    assert {x: roots.get(x, x) for x in signed} == want


def test_nulls_repeats_empty_table_and_other_columns(spark):
    rows = [(None, "same text of five words"), (3, "same text of five words"), (3, "same text of five words"), (5, None), (4, " "), (None, "quite another text without any partner")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", fp string, component_id int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (5, 4), (4, 4), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    staged = simhash.stage(spark, docs, "")
    assert staged.columns == docs.columns
    assert sorted((r["doc_id"] for r in staged.collect()), key=str) == sorted([None, None, 3, 3, 4], key=str)


def test_a_long_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert roots == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
