"""Work that has to grow no faster than its input, and to be dealt out to all cores."""

import hashlib

from pyspark.sql import functions as F

from codequarry.functions import code, elixir, match
from codequarry.functions import text as T
from codequarry.index import Index
from codequarry.operators import extract, paging, postings, store
from codequarry.plans import code_twins, index_twins, twins

NESTED = "defmodule A do\n  def run(x, y) do\n    " + "f(" * 40 + "x" + ", y)" * 40 + " |> Enum.map(1) |> g.()\n  end\nend\n"


def test_sources_are_dealt_out_before_they_are_parsed(spark):
    few = spark.createDataFrame([(str(i), f"# {i}\nf({i})\n") for i in range(64)], "path string, source string").coalesce(1)
    found = extract.rows(few, "comments", ["text"])
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.count() == 64


def test_a_sub_tree_is_hashed_once(monkeypatch):
    tree = elixir.parse(NESTED)
    n, seen = len(list(elixir.walk(tree))), []
    real = hashlib.sha256
    monkeypatch.setattr(code.hashlib, "sha256", lambda *a: seen.append(1) or real(*a))
    rows = code.fragments("a.ex", NESTED, tree, min_mass=1)
    assert len(seen) <= n + 2  # a pipe's right side is one tree of its own
    monkeypatch.undo()
    nodes = {(x.line, x.column, code.mass(x), code.exact_hash(x)): x for x in elixir.walk(tree) if isinstance(x, elixir.Node)}
    assert len(rows) > 40
    for r in rows:
        x = next(v for k, v in nodes.items() if k[2] == r["mass"] and k[3] == r["exact_hash"])
        assert (r["terms"], r["sub_hashes"], r["last_line"]) == (code.terms(x), code.sub_hashes(x), code.last_line(x))


def test_only_what_is_asked_for_is_made(monkeypatch):
    monkeypatch.setattr(code, "symbols", None)
    monkeypatch.setattr(code.hashlib, "sha256", None)
    assert [r["name"] for r in code.facts("fragments", "a.ex", NESTED, min_mass=1, fields=["name", "terms"], kinds=("def",))] == ["run"]
    assert code.facts("comments", "a.ex", "# a\nf(1)\n")[0]["text"] == "# a"


def test_extraction_of_the_twins_has_an_exchange_before_python(spark):
    plan = code_twins.call_graph_extract(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("MapInPandas") :]


def test_replacing_facts_neither_sorts_nor_broadcasts(spark):
    plan = twins.fact_replace(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan and "Broadcast" not in plan


def test_trees_of_unlike_sizes_are_not_aligned(monkeypatch):
    small, large = elixir.parse("f(x)"), elixir.parse("f(" + ", ".join("abcdefghijkl") + ")")
    exact = match.similarity(small, large)
    monkeypatch.setattr(match, "edit_distance", None)
    assert exact <= match.similarity(small, large, 0.9) < 0.9


def test_sources_of_an_index_are_dealt_out_and_staged_once(spark, tmp_path):
    rows = [(f"lib/{i}.ex", f"f({i})\nf({i})", "local", "a", "1.0.0", None, i) for i in range(64)]
    few = spark.createDataFrame(rows, "path string, source string, ecosystem string, name string, version string, source_ref string, ordinal long").coalesce(1)
    ix = Index.build(spark, few, f"file://{tmp_path}/ix", min_mass=1)
    assert len(list((tmp_path / "ix" / "_staged").glob("part-*.parquet"))) > 4
    assert ix.table("files").count() == 64
    want = hashlib.sha256("".join(sorted(hashlib.sha256(r[1].encode()).hexdigest() for r in rows)).encode()).hexdigest()
    assert [r["checksum"] for r in ix.table("package_versions").collect()] == [want]
    f = ix.table("file_terms").groupBy("file_id").agg({"tf": "sum"}).collect()
    assert {r[1] for r in f} == {4}


def test_a_function_that_comes_again_is_not_hashed_again(monkeypatch):
    source = "defmodule {0} do\n  def run(x), do: x |> Enum.map(& &1) |> Enum.sum()\n  def other(y), do: {{:ok, y}}\nend\n"
    first, second = (source.format(m) for m in ("Once", "Again"))
    code.extract("a.ex", first, min_mass=1)
    seen = []
    real = hashlib.sha256
    monkeypatch.setattr(code.hashlib, "sha256", lambda *a: seen.append(1) or real(*a))
    got = code.extract("b.ex", "\n\n" + second, min_mass=1)
    assert len(seen) <= 4  # what the module's name is in
    monkeypatch.undo()
    tree = elixir.parse(second)
    nodes = [x for x in elixir.walk(tree) if isinstance(x, elixir.Node) and x.args is not None and x.line and x.form not in ("__aliases__", "->", ".")]
    assert [(f["exact_hash"], f["terms"], f["sub_hashes"], f["mass"], f["line"]) for f in got["fragments"]] == [(code.exact_hash(x), code.terms(x), code.sub_hashes(x), code.mass(x), x.line + 2) for x in nodes]


def test_shapes_are_let_go_between_sources(monkeypatch):
    monkeypatch.setattr(code, "MOST_KEPT", 10_000)
    for k in range(50):
        code.extract("a.ex", f"def f{k}(x), do: [{k}, x, {{{k}, :a{k}}}]", min_mass=1)
    assert code._shapes.kept < 20_000


def test_words_in_workers_are_those_of_columns(spark):
    texts = ["aB1Cd_efGH! x?y __A_b HTTPServer a9B", "", "İK ſß Éa1\u00a0b\tB b", "def run(x) do\n  # Note 12_3\nend"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.identifier_tokens(F.col("t")).alias("i"), F.split(F.regexp_replace(F.lower("t"), T.WORD_BREAK, " "), " ").alias("w")).collect()
    for r in rows:
        assert T.identifier_tokens_of(r["t"]) == r["i"]
        assert T.word_counts(r["t"]) == {w: r["w"].count(w) for w in r["w"] if w}
    assert T.identifier_tokens_of(None) is None and T.word_counts(None) == {}


def test_all_rows_in_order_are_not_one_task(spark):
    rows = spark.range(10, numPartitions=3)
    plan = lambda limit: paging.page(rows.orderBy(F.desc("id")), 0, limit)._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan(2**31 - 1) and "SinglePartition" not in plan(2**31 - 1)
    assert [r[0] for r in paging.page(rows.orderBy(F.desc("id")), 2, 3).collect()] == [7, 6, 5]
    assert [r[0] for r in paging.page(rows.orderBy(F.desc("id")), 8, 2**31 - 1).collect()] == [1, 0]


def test_a_task_writes_versions_side_by_side_without_a_sort(spark, tmp_path):
    rows = [(f"lib/{i}.ex", f"f({i})", "local", f"p{i % 11}", "1.0.0", None, i) for i in range(66)]
    sources = spark.createDataFrame(rows, "path string, source string, ecosystem string, name string, version string, source_ref string, ordinal long")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    ix = Index.build(spark, sources, f"file://{tmp_path}/ix", min_mass=1)  # more versions than are written side by side
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert ix.table("files").count() == 66 and ix.table("files").select("package_version_id").distinct().count() == 11
    post = ix.table("fragment_terms")
    assert post.count() == post.distinct().count() > 66
    assert ix.table("file_terms").where(F.col("term_id") == F.xxhash64(F.lit("f"))).agg(F.sum("tf")).first()[0] == 66


def test_a_line_that_comes_again_is_not_scanned_again(monkeypatch):
    text = "def f(x) do\n  x |> g(1) # note\n\n  \"a\nb\" <> ?\n\nend"
    first = [repr(t) for t in elixir.tokenize(text)[0]], elixir.tokenize(text)[1]
    scanned = []
    real = elixir._scan
    monkeypatch.setattr(elixir, "_scan", lambda *a: scanned.append(a[0]) or real(*a))
    assert ([repr(t) for t in elixir.tokenize(text)[0]], elixir.tokenize(text)[1]) == first
    assert scanned == [text, text]  # once a call
    monkeypatch.setattr(elixir, "_line", lambda text: None)
    assert ([repr(t) for t in elixir.tokenize(text)[0]], elixir.tokenize(text)[1]) == first


def test_ranges_of_postings_are_sorted_by_one_number(spark):
    post = spark.createDataFrame([(t, f) for t in (5, 7) for f in range(100)], "term_id long, fragment_id long")
    plan = postings.clustered(post, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [term_id" in plan and "fragment_id" not in plan[plan.index("Sort [") :].split("]")[0]
    assert sorted(postings.clustered(post, 4).collect()) == sorted(post.collect())


def test_the_copy_of_postings_is_made_when_it_is_asked_for(spark):
    d = "/root/testdata/sf0.001/"
    ix = index_twins.index(spark, d)
    assert not ix.store._exists("postings_by_term")
    plain = ix.table("fragment_terms").select("term_id", "fragment_id").collect()
    assert index_twins.index(spark, d, ranged=True) is ix and ix.store._exists("postings_by_term")
    assert sorted(ix.table("fragment_terms").select("term_id", "fragment_id").collect()) == sorted(plain)


def test_symbols_of_nodes_that_are_known():
    tree = elixir.parse(NESTED)
    nodes = [x for x in elixir.walk(tree) if isinstance(x, elixir.Node)]
    assert code.symbols(tree, nodes) == code.symbols(tree)
    assert code.extract("a.ex", NESTED, min_mass=1)["definitions"] == code.symbols(tree)[0]


FUNCTION = "  def f(x) do\n    # {0}\n    x |> B.g(1) |> h() # more {0}\n  end\n"


def test_a_function_that_comes_again_is_not_parsed_again(monkeypatch):
    source = "defmodule {0} do\n  alias A.B\n" + FUNCTION + "\n  def k(y) do\n    {{:ok, @z, y}}\n  end\nend\n"
    first, second = (source.format(m) for m in ("OnceMore", "AndAgain"))
    code.extract("a.ex", first, min_mass=1)
    seen = []
    real = elixir.Parser.do_block
    monkeypatch.setattr(elixir.Parser, "do_block", lambda self: seen.append(1) or real(self))
    got = code.extract("b.ex", second, min_mass=1)
    assert len(seen) == 1  # the module's
    monkeypatch.setattr(elixir, "_function", lambda *a: None)
    alone = code.extract("b.ex", second, min_mass=1)
    assert len(seen) == 4
    assert [f.pop("places", None) is not None for f in got["fragments"]].count(True) > 4
    assert got == alone


def test_what_only_looks_like_a_function_of_its_own_is_parsed_with_what_is_around_it(monkeypatch):
    f = "def a(x) do\n  x\nend"
    around = ["foo a,\n{}\n", "foo x =\n{}\n", "foo.\n{}\n", "{}\n|> g(1)\n", "{}.x\n", "[a,\n{}]\n", "foo(\n{}\n)\n", "not\n{}\n", "x and\n{}", "\"\"\"\n{}\n\"\"\"\n", "{}\nend\n", "f fn y ->\n{}\nend\n", "{}, 2\n"]
    inside = ["def a do\n  \"x\nend\n\"\nend", "def a do\n  if x do\n 1\nend\nend", "def a do\n ?#\nend", "def a do\n  quote do\n    defmodule X do\n    end\n  end\nend", "def a, do: 1\ndef b do\n  2\nend", "def a do\n{\nend"]
    sources = [x.format(f) for x in around] + inside + [f"defmodule M do\n{x}\nend\n" for x in inside]
    made = [[code.extract("a.ex", s, min_mass=1) for s in sources] for _ in range(2)]
    monkeypatch.setattr(elixir, "_function", lambda *a: None)
    alone = [code.extract("a.ex", s, min_mass=1) for s in sources]
    for found in made:
        for got in found:
            for row in got["fragments"] if got else ():
                row.pop("places", None)
        assert found == alone
    assert None in alone and any(alone)


def test_functions_are_let_go(monkeypatch):
    monkeypatch.setattr(elixir, "MOST_NODES", 100)
    for k in range(60):
        code.extract("a.ex", f"def f{k}(x) do\n  x\nend\n", min_mass=1)
    assert 0 < len(elixir._FUNCTIONS) <= 40 and elixir._nodes_kept <= 100


def test_versions_are_summed_up_once(spark, tmp_path, monkeypatch):
    rows = [(f"lib/{i}.ex", f"f({i})", "local", f"p{i % 3}", "1.0.0", None, i) for i in range(9)]
    sources = spark.createDataFrame(rows, "path string, source string, ecosystem string, name string, version string, source_ref string, ordinal long")
    runs = spark.sparkContext.accumulator(0)
    real = store.map_arrow

    def counted(df, function, fields):
        if "checksum" not in fields:
            return real(df, function, fields)

        def run(batches):
            for b in batches:
                runs.add(b.num_rows)
                yield from function(iter([b]))
        return real(df.coalesce(1), run, fields)

    monkeypatch.setattr(store, "map_arrow", counted)
    ix = Index.build(spark, sources, f"file://{tmp_path}/ix", min_mass=1)
    assert runs.value == 9
    assert ix.table("package_versions").where("index_state = 'complete'").count() == 3
