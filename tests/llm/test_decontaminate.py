"""Decontamination against brute force and SQL."""

import random

import brute
import duckdb
import pyarrow as pa

from codequarry.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def fixture(seed=1):
    pick = random.Random(seed)
    word = lambda: pick.choice(["the", "a", "of", "Ünder", "x1", "river", "Stone", "light", "7", "ñandú"])
    bench = [(i, " ".join(word() for _ in range(pick.choice([1, 2, 3, 5, 8, 12, 13, 14, 20, 40])))) for i in range(30)]
    bench += [(100, None), (101, ""), (102, "... !"), (103, bench[4][1].upper()), (9, "another text of item nine with words")]
    docs = [(1, None), (2, ""), (3, "-- --")]
    for i in range(4, 90):
        parts = [" ".join(word() for _ in range(pick.randint(0, 60)))]
        for _ in range(pick.randint(0, 2)):
            item = (pick.choice(bench)[1] or "").split()
            a = pick.randint(0, max(0, len(item) - 13))
            parts.append("; ".join(item[a : a + pick.randint(5, 40)]))
            parts.append(" ".join(word() for _ in range(pick.randint(0, 200))))
        docs.append((i, "\n".join(parts)))
    docs.append((200, "the the the the " * 400 + (bench[3][1] or "")))
    return docs, bench


def test_equals_brute_force_and_sql(spark):
    docs, bench = fixture()
    got = decontaminate.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, ITEMS))
    rows = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect())
    want = sorted(brute.contamination(docs, bench))
    assert rows == want and 10 < sum(x[4] for x in want) and any(0 < x[2] and not x[4] for x in want)
    con = duckdb.connect()
    for name, key, table in (("documents", "doc_id", docs), ("benchmark", "item_id", bench)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", table)
    sql = con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({decontaminate.ORACLE}) ORDER BY ALL").fetchall()
    assert sql == [(i, w, h, len(x), brute.sha(",".join(x)), c) for i, w, h, x, c in want]
    most = con.execute(f"SELECT doc_id, longest_words, longest_at, longest_item, longest_item_at FROM ({decontaminate.ORACLE}) ORDER BY ALL").fetchall()
    assert most == sorted((r["doc_id"], *tuple(r)[-4:]) for r in got.collect())


def test_many_blocks_give_the_same(spark, monkeypatch):
    docs, bench = fixture(2)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    got = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, ITEMS))
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()) == sorted(brute.contamination(docs, bench))


def test_a_shards_suffixes_do_not_cross_documents():
    item = " ".join(f"t{i}" for i in range(13))
    tests = decontaminate.Tests.of([(1, item)])
    words, offsets = decontaminate.hashed_words(pa.array(["x t0 t1 t2 t3 t4 t5 t6", "t7 t8 t9 t10 t11 t12", item]))
    at, _ = decontaminate.find(words, offsets, tests)
    assert at.tolist() == [14]


def test_longest_matches_and_their_places(spark):
    item = " ".join(f"q{i}" for i in range(50))
    docs = [(1, "p p " + " ".join(f"Q{i}" for i in range(5, 40)) + " r"), (2, item + " x " + item), (3, "q1 q2 q3")]
    got = decontaminate.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(8, item)], ITEMS))
    assert sorted(map(tuple, got.collect())) == [(1, "8", 2, 5, 35), (2, "8", 0, 0, 50), (2, "8", 51, 0, 50)]


def longest_match(text, bench, size=13):
    """Words, place, item and place in the item of the longest match, by trying all pairs of places."""
    words = lambda t: brute.ALNUM_WORD.findall((t or "").translate(brute.LOWER))
    w, best = words(text), (0, 0, "", 0)
    for item, t in bench:
        v = words(t)
        for p in range(len(w)):
            for q in range(len(v)):
                n = 0
                while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                    n += 1
                if n and n >= min(size, len(v)):
                    best = min(best, (-n, p, str(item), q))
    return (-best[0], *best[1:]) if best[0] else (0, None, None, None)


def test_the_query_gives_the_longest_match(spark, tmp_path, monkeypatch):
    docs, bench = fixture(3)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {i: longest_match(t, bench) for i, t in docs if i < 40}
    assert any(x[0] > 13 for x in want.values()) and any(x[0] == 0 for x in want.values())
    for block in (decontaminate.BLOCK_BYTES, 400):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = {r["doc_id"]: tuple(r)[-4:] for r in decontaminate.query(spark, str(tmp_path)).collect() if r["doc_id"] < 40}
        assert got == want


def test_the_stage_drops_short_passages_in_long_texts_and_keeps_clean_ones(spark, tmp_path):
    item, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "uv")
    filler = " ".join(f"w{i % 97}" for i in range(5000))
    docs = [
        (1, filler + " " + item + " " + filler), (2, filler), (3, " ".join(item.split()[:12]) + " " + filler), (4, " ".join(item.split()[4:17]).upper()),
        (5, "A line of its own here.\n" + other), (6, "Another line of its own.\n" + other), (7, "yes " + filler), (8, "yes"), (9, None), (10, ""),
    ]
    spark.createDataFrame([(1, item), (2, other), (3, "yes")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = decontaminate.stage(spark, spark.createDataFrame(docs, DOCS), str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3, 7, 9, 10]


def test_a_text_of_more_than_one_step(spark):
    item = " ".join(f"k{i}" for i in range(30))
    docs = [(1, "some words and " * 150_000 + item + " more" * 700_000), (2, item), (3, "some words")]
    assert len(docs[0][1]) > 5 << 20
    got = {r["doc_id"]: tuple(r) for r in decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(8, item)], ITEMS)).collect()}
    assert got[1] == (1, 450_000 + 30 + 700_000, 30, 1, ["8"], False, 30, 450_000, "8", 0) and got[2][5] and not got[3][2]


def test_nulls_repeats_empty_tables_and_other_columns(spark, tmp_path):
    item = " ".join(f"z{i}" for i in range(15))
    docs = spark.createDataFrame([(None, item, "a"), (2, item, None), (2, item, "a"), (3, None, "b")], DOCS + ", items string")
    bench = spark.createDataFrame([(None, item), (5, item), (5, item)], ITEMS)
    got = sorted(((r["doc_id"], r["n_items"], r["items"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(None, 2, ["5", "null"], True), (2, 2, ["5", "null"], True), (2, 2, ["5", "null"], True), (3, 0, [], False)], key=str)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert [r["n_hit"] for r in decontaminate.contamination(docs, bench.limit(0)).collect()] == [0, 0, 0, 0]
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = decontaminate.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(3, None, "b")]
