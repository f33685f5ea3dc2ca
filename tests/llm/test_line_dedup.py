"""Line dedup against brute force and SQL."""

import random

import brute
import duckdb

from codequarry.llm import line_dedup

SCHEMA = "doc_id long, text string"


def fixture(n=80):
    pick = random.Random(11)
    pool = ["A line that many documents share", "  a LINE that many documents share\t", "short", "ten chars!", "exactly 10", "", "   ", "Äußerst lange Zeile äöü", "ÄUßERST lange Zeile äöü", "tab\tinside the line", "\x0bvertical tab around\x0c\r", "nine char", "emoji 🎉🎉🎉 line"]
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a line that many documents share"), (5, "own line of five\n" * 3)]
    rows += [(i, "\n".join(pick.choice([*pool, f"line {i} {pick.random()}"]) for _ in range(pick.randint(1, 12)))) for i in range(6, n)]
    return rows


def test_equals_brute_force_and_sql(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.drop_repeated_lines(docs).collect())
    want = sorted(brute.line_dedup(rows))
    assert got == want and sum(x[2] for x in want) > 50
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    sql = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.ORACLE}) ORDER BY ALL").fetchall()
    assert sql == [(i, n, d, brute.sha(t)) for i, n, d, t in want]


def test_one_line_in_every_document_and_a_very_long_text(spark):
    rows = [(i, "the very same line everywhere\nand one of its own " + str(i)) for i in range(500)]
    rows.append((1000, "\n".join(["the very same line everywhere"] * 20_000 + ["the end of the long one"])))
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(r["n_dropped"] for r in got.values()) == 499 + 20_000
    assert got[1000]["text"] == "the end of the long one" and got[0]["n_dropped"] == 0


def test_nulls_repeats_empty_table_and_other_columns(spark):
    rows = [(None, "a line of two documents", 9, "k"), (7, "a line of two documents", 9, None), (7, "a line of two documents", 8, "k"), (7, "another text of the same id", 8, "k")]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_dropped int, key string")
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in out.collect()), key=str) == sorted(
        [(None, "", 1), (7, "a line of two documents", 0), (7, "a line of two documents", 0), (7, "another text of the same id", 0)], key=str)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(fixture(20), SCHEMA)
    plan = line_dedup.drop_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_stage_keeps_columns_and_counts_anew(spark):
    docs = spark.createDataFrame([(1, "shared line of text\nown", "en", "s", 99), (2, "shared line of text\nmine ü", "de", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = line_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "shared line of text\nown", "en", "s", 23), (2, "mine ü", "de", None, 6)]
