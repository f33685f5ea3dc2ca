"""Facts are stored once, in the row of their source; tables of facts are read from there."""

import hashlib

import pytest
from pyspark.sql import functions as F

from codequarry.functions import code
from codequarry.index import Index
from codequarry.operators import postings, store

TREES = "defmodule A.{0} do\n  def f(x), do: \"日本\" <> x\n  def g(x) do\n    x |> {0}.h(1) |> f() # {0}\n  end\nend\nf(1); f(1)\n"


def test_facts_are_stored_once_and_tables_read_from_them(spark, tmp_path):
    rows = [(f"lib/{i}.ex", TREES.format(f"M{i}"), "local", f"p{i % 2}", "1.0.0", None, i) for i in range(4)]
    sources = spark.createDataFrame(rows, "path string, source string, ecosystem string, name string, version string, source_ref string, ordinal long")
    ix = Index.build(spark, sources, f"file://{tmp_path}/ix", min_mass=1)
    assert not [t for t in store.VIEWS if ix.store._exists(t)]
    got = ix.table("fragments").join(ix.table("files").select(F.col("id").alias("file_id"), "path"), "file_id").collect()
    for path, source, *_ in rows:
        want, seen = [], set()
        for f in code.extract(path, source, min_mass=1)["fragments"]:
            if (f["line"], f["exact_hash"]) not in seen:
                seen.add((f["line"], f["exact_hash"]))
                want.append((f["ordinal"], f["kind"], f["module"], f["name"], f["arity"], f["line"], f["end_line"], f["last_line"], f["mass"], f["exact_hash"], f["sub_hashes"], f["ast"]))
        mine = sorted([r for r in got if r["path"] == path], key=lambda r: r["ordinal"])
        assert [(r["ordinal"], r["kind"], r["module"], r["name"], r["arity"], r["line"], r["end_line"], r["last_line"], r["mass"], r["exact_hash"], r["sub_hashes"], r["ast"]) for r in mine] == want
        for r in mine:
            assert r["content_hash"] == hashlib.sha256(f"{r['package_version_id']}|{path}|{r['line']}|{r['exact_hash']}".encode()).hexdigest()
    # of a tree's text no second copy is stored
    assert not [f for f in spark.read.parquet(ix.store.path("facts")).columns if f.startswith("fragments_ast") and f not in ("fragments_ast_at", "fragments_ast_size")]


def test_a_copy_of_a_table_of_facts_is_read_until_the_index_changes(spark, tmp_path):
    rows = [(f"lib/{i}.ex", TREES.format(f"M{i}"), "local", f"p{i % 2}", "1.0.0", None, i) for i in range(4)]
    sources = spark.createDataFrame(rows, "path string, source string, ecosystem string, name string, version string, source_ref string, ordinal long")
    ix = Index.build(spark, sources, f"file://{tmp_path}/ix", min_mass=1)
    tables = ("files", "fragment_terms", "graph_nodes")
    before = {t: sorted(map(str, ix.table(t).collect())) for t in tables}
    for t in tables:
        for _ in range(2):
            ix.store.compact(t, 1)
            assert sorted(map(str, ix.table(t).collect())) == before[t]
            assert len(list((tmp_path / "ix" / t).glob("package_version_id=*/part-*.parquet"))) == 2
    ix.store.index(sources.where("name = 'p1'").withColumn("source", F.replace("source", F.lit("def g("), F.lit("def k("))), min_mass=1)
    assert sorted(r[0] for r in ix.table("definitions").where("kind = 'def' AND name <> 'f'").select("qualified_name").collect()) == ["A.M0.g/1", "A.M1.k/1", "A.M2.g/1", "A.M3.k/1"]
    assert ix.table("file_terms").where(F.col("term_id") == F.xxhash64(F.lit("g"))).count() == 2


def test_frequencies_are_counted_of_terms_that_patterns_have(spark, tmp_path):
    rows = [("lib/a.ex", "f(1)\ng(h(2))\n", "local", "p", "1.0.0", None, 0)]
    ix = Index.build(spark, spark.createDataFrame(rows, "path string, source string, ecosystem string, name string, version string, source_ref string, ordinal long"), f"file://{tmp_path}/ix", min_mass=1)
    seen = []
    real = postings.document_frequency
    with pytest.MonkeyPatch.context() as m:
        m.setattr(postings, "document_frequency", lambda post, *a: seen.append(post.select("term_id").distinct().count()) or real(post, *a))
        found = ix.audit({"h": ["h(_)"]}, mode="anchor").collect()
    assert [(r["check"], r["line"]) for r in found] == [("h", 2)] and seen[0] <= 2 < ix.table("terms").count()


MODULES = [
    "defmodule {0} do\n  alias X.Yy, as: Zz\n  def run(x) do\n    Zz.go(x) |> Enum.map(2) # {0} {1}\n  end\n\n  # {1}\n  defp k(y), do: [:a, y, {{1.5, y}}]\n\n  defmodule In do\n    def f(q) do\n      g(q)\n    end\n  end\nend\ng(1); g(1)\n",
    "defmodule {0} do\n  def f(x) do\n    \"a{1}\" <> x\n  end\nend\n",
    "defmodule {0} do\n  def f(x) do\n    {0}.g(x)\n  end\nend\n",
    "defmodule {0} do\n  def f(x) do\n    (x\n  end\nend\n",
    "defmodule {0} do\n  ü = x\n  def f(x) do\n    ü.(x)\n  end\nend\n",
]
NAMES = ["Ab", "Cd", "Ef", "Gh", "Kl", "Mn", "En", "Yy", "In", "Abc", "Ghi", "Enum", "Abcd", "Wxyz"]


def test_a_module_that_comes_again_under_other_names_has_the_same_facts_as_alone(monkeypatch):
    def gathered(f):
        out = []
        for least in (1, 4):
            for k, n in enumerate(NAMES):
                for m in MODULES:
                    into = {c: [] for c in code.COLUMNS}
                    got = f(m.format(n, k), into, least)
                    if got is not None:
                        into["terms"] = [sorted(got["terms"][t] for t in x) for x in into["terms"]]
                        got = got | {"terms": sorted(got["terms"]), "ast_of": [got["ast"].encode()[a : a + s] for a, s in zip(into["ast_at"], into["ast_size"])]}
                    out.append((m.format(n, k), into, got))
        return out

    alone = gathered(code._columns)
    monkeypatch.setattr(code, "_MODULES", {})
    monkeypatch.setattr(code, "_ONCE", set())
    put = []
    real = code._Module.put
    monkeypatch.setattr(code._Module, "put", lambda self, *a: put.append(1) or real(self, *a))
    assert gathered(lambda s, into, least: code.columns("lib/a.ex", s, into, min_mass=least)) == alone
    assert len(put) >= 6
    for source, into, got in alone[: len(alone) // 2]:
        rows = code.extract("lib/a.ex", source, min_mass=1)
        assert (rows is None) == (got is None)
        if rows is not None:
            first = {}
            for f in rows["fragments"]:
                first.setdefault((f["line"], f["exact_hash"]), f)
            assert [[f[n] for f in first.values()] for n in ("ordinal", "kind", "module", "name", "end_line", "mass", "exact_hash", "sub_hashes", "terms")] == [into[n] for n in ("ordinal", "kind", "module", "name", "end_line", "mass", "exact_hash", "sub_hashes", "terms")]
            assert [f["ast"].encode() for f in first.values()] == got["ast_of"]


def test_modules_are_let_go(monkeypatch):
    monkeypatch.setattr(code, "_MODULES", {})
    monkeypatch.setattr(code, "MOST_MODULES", 2000)
    for k in range(40):
        for n in ("Ab", "Cd", "Ef"):
            code.columns("a.ex", f"defmodule {n} do\n  def f(x) do\n    x + {k}\n  end\nend\n", {c: [] for c in code.COLUMNS}, min_mass=1)
    assert 0 < len(code._MODULES) < 10
