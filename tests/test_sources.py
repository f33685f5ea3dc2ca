"""Sources, registries, tarballs, streams, and small functions over columns."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.functions.locations import literal_locations, regex_locations
from codequarry.index import Index
from codequarry.operators import paging
from codequarry.operators.store import Store
from codequarry.sources import files
from codequarry.streaming import ingest

CODE = "defmodule {} do\n  def run(x), do: String.trim(x)\nend\n"


def test_paths_are_filtered(spark, tmp_path):
    for name, content in {"a.ex": CODE.format("A").encode(), "sub/b.exs": b"IO.puts(1)\n", "._c.ex": b"x", "d.txt": b"x", "e.ex": b"\xff\xfe\x00", "big.ex": b"#" * (files.MOST_BYTES + 1)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = files.from_paths(spark, str(tmp_path), relative_to=str(tmp_path))
    assert sorted(r["path"] for r in got.collect()) == ["a.ex", "sub/b.exs"]


def test_registry(spark):
    packages = spark.createDataFrame([("a", ["1.2.0", "1.10.0", "1.10.0-rc.1", "weird"], 5), ("b", ["0.9.0-beta.2", "0.9.0-beta.11"], 9), ("c", ["odd"], None)], "name string, versions array<string>, downloads long")
    assert {r["name"]: r["version"] for r in files.latest(packages).collect()} == {"a": "1.10.0", "b": "0.9.0-beta.11", "c": "odd"}
    assert files.all_versions(packages).count() == 7
    assert [r["name"] for r in files.top(packages, 2).collect()] == ["b", "a"]


def test_entry_lists_and_mirrors(spark, tmp_path):
    (tmp_path / "list.ndjson").write_text('{"name":"a","version":"1"}\n{"name":"b","version":"2"}\n')
    (tmp_path / "report.json").write_text('{"ok": 1,\n "failures": [{"name": "z", "version": "3", "reason": "x"}]}')
    assert [tuple(r) for r in files.entries(spark, str(tmp_path / "list.ndjson")).collect()] == [("a", "1"), ("b", "2")]
    assert [tuple(r) for r in files.entries(spark, str(tmp_path / "report.json"), report=True).collect()] == [("z", "3")]
    rings = [r["mirrors"] for r in files.round_robin(files.entries(spark, str(tmp_path / "list.ndjson")), ["m1", "m2", "m3"]).collect()]
    assert all(sorted(r) == ["m1", "m2", "m3"] for r in rings)


def tarball(path, members):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with tarfile.open(path, "w") as t:
        info = tarfile.TarInfo("contents.tar.gz")
        info.size = len(inner.getvalue())
        t.addfile(info, io.BytesIO(inner.getvalue()))


def test_tarballs(spark, tmp_path):
    (tmp_path / "good").mkdir()
    tarball(tmp_path / "good" / "my-pkg-1.2.3.tar", {"lib/a.ex": CODE.format("A").encode(), "README.md": b"x", "lib/._b.ex": b"y"})
    (r,) = files.from_tarballs(spark, str(tmp_path / "good")).collect()
    assert (r["name"], r["version"], r["path"], r["ecosystem"]) == ("my-pkg", "1.2.3", "lib/a.ex", "hex")
    tarball(tmp_path / "bad-1.0.0.tar", {"../evil.ex": b"x"})
    with pytest.raises(Exception, match="unsafe path"):
        files.from_tarballs(spark, str(tmp_path / "bad-1.0.0.tar")).collect()


def test_streamed_sources_are_indexed_once(spark, tmp_path):
    rows = files.from_rows(spark, [("lib/a.ex", CODE.format("A"), {"name": "a"}), ("lib/b.ex", CODE.format("B"), {"name": "b"})])
    rows.write.json(str(tmp_path / "in"))
    store = Store(spark, f"file://{tmp_path}/index")
    for _ in range(2):
        ingest.ingest(ingest.read_sources(spark, str(tmp_path / "in")), store, str(tmp_path / "checkpoint"), min_mass=1).awaitTermination(120)
    index = Index.open(spark, f"file://{tmp_path}/index")
    assert index.count("from(f in File)") == 2
    files.from_rows(spark, [("lib/c.ex", CODE.format("C"), {"name": "c"})]).write.mode("append").json(str(tmp_path / "in"))
    ingest.ingest(ingest.read_sources(spark, str(tmp_path / "in")), store, str(tmp_path / "checkpoint"), min_mass=1).awaitTermination(120)
    assert Index.open(spark, f"file://{tmp_path}/index").count("from(f in File)") == 3


def test_progress_by_event_time(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, if(id % 3 = 0, 'error', 'ok') AS status FROM range(12)").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, status string").parquet(str(tmp_path / "e"))
    q = ingest.package_progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["status"], r["n"]) for r in spark.table("progress").groupBy("status").agg(F.sum("n").alias("n")).collect()} == {("ok", 8), ("error", 4)}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.identifier_tokens(F.lit("Repo.get!(MyApp, handle_event)"))) == "repo get my app handle event"
    assert one(T.line_slice(F.lit("a\nb\nc\nd"), F.lit(2), F.lit(3))) == "b\nc" and one(T.line_slice(F.lit("a\nb\nc"), F.lit(2))) == "b\nc"
    assert one(T.snippet(F.lit("\n".join("abcdefgh")), F.lit(4))) == "b\nc\nd\ne\nf" and one(T.context(F.lit("\n".join("abcdefgh")), F.lit(1), 1)) == "a\nb"
    assert one(T.prefix_ilike(F.lit("A_bc"), "a_")) and not one(T.prefix_ilike(F.lit("Abbc"), "a_"))
    assert one(T.qualified_name(F.lit("M"), F.lit("f"), F.lit(2))) == "M.f/2" and one(T.qualified_name(F.lit(None).cast("string"), F.lit("f"), F.lit(0))) == "f/0"
    assert sorted(one(T.char_trigrams(F.lit("AbcaBc")))) == ["abc", "bca", "cab"]
    import re

    assert re.match(T.glob_regex("lib/**/*.ex"), "lib/a/b/c.ex") and re.match(T.glob_regex("lib/*.ex"), "lib/a.ex") and not re.match(T.glob_regex("lib/*.ex"), "lib/a/b.ex")
    for bad in ("/abs", "../x", "a/../b", ""):
        with pytest.raises(ValueError):
            T.glob_regex(bad)


def test_locations():
    assert list(literal_locations("aXa\n Xa", "Xa")) == [(1, 2), (2, 2)] and list(literal_locations("aaaa", "aa")) == [(1, 1), (1, 3)]
    assert list(literal_locations("éx", "x")) == [(1, 2)]
    assert list(regex_locations("ab\ncab", "(a)b")) == [(1, 1), (2, 2)]


def test_cursors_ranks_and_samples(spark):
    assert paging.decode_cursor(paging.encode_cursor(3, "x")) == [3, "x"] and paging.decode_cursor("%%%") == [0] and paging.decode_cursor(None) == [0]
    hits = spark.createDataFrame([(1, 1.0, "expression", "lib/a.ex", 1), (2, 1.0, "def", "test/a.exs", 1), (3, 1.0, "def", "lib/b.ex", 2), (4, 2.0, "other", None, None)], "id long, score double, kind string, path string, line int")
    assert [r["id"] for r in paging.ranked(hits).collect()] == [4, 3, 2, 1] and [r["id"] for r in paging.ranked(hits, skip=1, limit=2).collect()] == [3, 2]
    assert tuple(paging.bounded_count(hits, 3).first()) == (3, "gte") and tuple(paging.bounded_count(hits, 4).first()) == (4, "eq")
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    got = sorted(r["id"] for r in paging.even_sample(df, ["id"], 5).collect())
    assert got == [0, 250, 500, 749, 999] or got == [0, 250, 499, 749, 999] or len(got) == 5
    assert paging.even_sample(df, ["id"], 0).count() == 0 and paging.even_sample(df.limit(3), ["id"], 5).count() == 3
