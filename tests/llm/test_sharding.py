"""Virtual slots and the map from slots to shards."""

import zlib

import pytest

from codequarry.llm import sharding
from codequarry.llm.sharding import SHARDS, SlotMap, SlotMapStore

SCHEMA = "doc_id long, text string"


def result(spark, rows, now=None, schema=SCHEMA):
    now = now or SlotMap.first(SHARDS)
    return sharding.assign(spark.createDataFrame(rows, schema).repartition(3), now, now.grown()).collect()


def check(rows, got):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
        ((r[0], 8 + len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert 0 <= r["shard"] < SHARDS and r["grown_shard"] in (r["shard"], SHARDS) and r["law"] == "key"
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_every_row_once_and_positions_without_gaps(spark):
    rows = [(i, None if i % 50 == 0 else "täxt " * (i % 7)) for i in range(3000)]
    got = result(spark, rows)
    check(rows, got)
    moved = sum(r["grown_shard"] == SHARDS for r in got)
    assert 0.02 * len(rows) < moved < 0.07 * len(rows)
    # the shard follows from the id alone: fewer rows, other texts, the same shards
    some = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in result(spark, [(i, "other") for i in range(0, 3000, 3)])}
    assert some == {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in got if r["doc_id"] % 3 == 0}


def test_nulls_a_hot_id_empty_table_and_other_columns(spark):
    rows = [(5, "hot")] * 700 + [(i, f"t{i}") for i in range(400)] + [(None, None), (None, "x"), (5, "cold")]
    check(rows, result(spark, rows))
    clash = [(*r, "y", 2) for r in rows[600:750]]
    check(clash, result(spark, clash, schema=SCHEMA + ", slot string, virtual_slot int"))
    assert result(spark, []) == []


def test_growing_moves_slots_only_into_the_new_shard():
    now = SlotMap.first(7, 100)
    for _ in range(5):
        later = now.grown()
        assert later.version == now.version + 1 and later.shards == now.shards + 1
        assert {b for _, b in now.moved(later).values()} == {now.shards}
        count = [later.owner.count(k) for k in range(later.shards)]
        assert max(count) - min(count) <= 2
        now = later
    with pytest.raises(ValueError):
        SlotMap.first(0)


def test_rebalancing_by_bytes(spark):
    rows = [(i, "x" * (20_000 if i % 97 == 0 else 10)) for i in range(4000)]
    loads = {s: b for s, (_, b) in sharding.loads_of(sharding.placed(spark.createDataFrame(rows, SCHEMA))).items()}
    assert sum(loads.values()) == sum(len(t) + 8 for _, t in rows)
    now = SlotMap.first(8)
    later = now.rebalanced(loads)
    total = lambda m: [sum(loads.get(s, 0) for s, k in enumerate(m.owner) if k == j) for j in range(m.shards)]
    spread = lambda m: max(total(m)) - min(total(m))
    assert spread(later) < 0.25 * spread(now) and spread(later) <= 0.2 * sum(total(now)) / 8
    assert later.version == 2 and now.owner == SlotMap.first(8).owner


def test_versions_are_kept_and_never_changed(spark, tmp_path):
    store = SlotMapStore(spark, f"file://{tmp_path}/map")
    first = SlotMap.first(24)
    store.save(first, {0: (2, 50), 4095: (1, 9)})
    store.save(first.grown())
    assert store.load(1) == first and store.load(2) == first.grown()
    assert {r["shard"]: (r["rows"], r["bytes"]) for r in store.loads(1).where("rows > 0").collect()} == {0: (2, 50), 23: (1, 9)}
    with pytest.raises(Exception, match="(?i)already exists"):
        store.save(first)
