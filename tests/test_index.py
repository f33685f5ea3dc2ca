"""The engine end to end on small sources of our own."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import match
from codequarry.index import Index, LimitError, sharded
from codequarry.operators import audits, joins, postings
from codequarry.operators.store import FormatError, Store, publish
from codequarry.plans.model import Query, QueryError
from codequarry.sources import files

DEMO = '''defmodule Demo do
  def run(list) do
    label = "some label"
    first = Map.get(list, :first)
    Enum.map(list, fn x -> {label, first, x} end)
  end

  def other do
    # TODO tidy
    :done
  end
end
'''
JOIN = '''defmodule Both do
  def run(xs) do
    Enum.map(xs, & &1)
  end

  def other(s) do
    String.trim(s)
  end
end
'''
VARIANT = '''def sum_all(items, start) do
  total = Enum.reduce(items, start, fn x, acc -> x + acc end)
  IO.puts("total")
  total * 2
end
'''


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    rows = [("lib/demo.ex", DEMO, {"name": "demo", "version": "1.0.0"}), ("lib/both.ex", JOIN, {"name": "both", "version": "0.1.0"}), ("lib/bad.ex", "defmodule <%= x %> do end (", {"name": "bad", "version": "1.0.0"})]
    return Index.build(spark, files.from_rows(spark, rows), f"file://{tmp_path_factory.mktemp('index')}", min_mass=1)


def names(df, binding="f"):
    return [r[binding]["name"] for r in df.collect()]


def test_root_patterns_and_contains(demo):
    scope = demo.scope_ids(version=("local", "demo", "1.0.0"))
    ask = lambda where: sorted(names(demo.all(f"from(f in Fragment, {where})", **scope)))
    assert ask("where: matches(f, def _ do ... end)") == ["other", "run"]
    assert ask("where: matches(f, def _ do ... end), where: contains(f, Enum.map(...))") == ["run"]
    assert ask('where: matches(f, def _ do ... end), where: contains(f, "# TODO")') == ["other"]
    assert ask('where: matches(f, def _ do ... end), where: contains(f, "TODO")') == ["other"]
    assert ask('where: matches(f, def _ do ... end), where: contains(f, "absent")') == []
    assert ask("where: matches(f, def run(_) do ... end)") == ["run"]
    q = "from(f in Fragment, where: matches(f, def run(_) do ... end))"
    assert demo.count(q, **scope) == 1
    p = demo.plan(q)
    assert (p.kind, p.name, p.arity) == ("def", "run", 1)
    missing = demo.estimate("from(f in Fragment, where: contains(f, Nowhere.to_be(...)))")
    assert (missing.value, missing.relation) == (0, "eq")


def test_joins(demo):
    q = 'from(f in Fragment, join: r in assoc(f, :references), where: f.kind == :def, where: r.qualified_name == "Enum.map/2", select: {f, r})'
    rows = demo.all(q, **demo.scope_ids(package=("local", "both"))).collect()
    assert [(r["f"]["name"], r["r"]["qualified_name"]) for r in rows] == [("run", "Enum.map/2")]
    both = 'from(f in Fragment, join: d in assoc(f, :definitions), join: r in assoc(f, :references), join: c in assoc(f, :calls), where: r.qualified_name == "String.trim/1", select: {f, d, c})'
    (row,) = demo.all(both).collect()
    assert row["f"]["name"] == "other" and row["c"]["caller_qualified_name"] == row["d"]["qualified_name"] == "Both.other/1"
    calls = demo.all('from(d in Definition, join: c in assoc(d, :calls), where: d.name == "run", select: {d, c})').collect()
    assert {r["c"]["callee_qualified_name"] for r in calls} == {"Enum.map/2", "Map.get/2"}
    only = demo.all('from(f in Fragment, join: r in assoc(f, :references), where: r.name == "trim", select: r)').collect()
    assert only[0]["r"]["name"] == "trim"
    with_pattern = 'from(f in Fragment, join: r in assoc(f, :references), where: matches(f, def _ do ... end), where: r.name == "map")'
    assert set(names(demo.all(with_pattern))) == {"run"}
    plan = demo.all(q)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "TakeOrderedAndProject" in plan


def test_pages_concatenate(demo):
    q = "from(f in Fragment, where: f.mass > 2)"
    whole = [(r["f"]["mass"], r["f"]["id"]) for r in demo.all(q, limit=1000).collect()]
    got, cursor = [], None
    while page := demo.all(q, limit=5, cursor=cursor).collect():
        got += [(r["f"]["mass"], r["f"]["id"]) for r in page]
        cursor = got[-1]
    assert got == whole and len(whole) > 10


def test_entities_and_codec(demo):
    assert demo.count('from(f in File, where: prefix_search(f.path, "lib/"))') == 3
    assert demo.count("from(p in Package)") == 3
    assert demo.count('from(v in PackageVersion, where: v.version == "1.0.0")') == 2
    q = demo.query('from(f in File, where: f.path in ["lib/demo.ex"], limit: 3)')
    assert Query.from_map(q.to_map()) == q
    assert demo.count(q.to_map()) == 1
    with pytest.raises(QueryError, match="version"):
        Query.from_map(q.to_map() | {"version": 2})


@pytest.mark.parametrize("bad", [
    "from(f in Nothing)", "from(f in File, join: r in assoc(f, :references))", "from(f in Fragment, join: r in assoc(x, :references))",
    "from(f in Fragment, join: r in assoc(f, :authors))", "from(f in Fragment, join: r in assoc(f, :calls), join: s in assoc(f, :calls))",
    "from(f in Fragment, join: f in assoc(f, :calls))", "from(f in Fragment, where: g.kind == :def)", "from(f in Fragment, where: f.source == :def)",
    "from(p in Package, where: matches(p, _))", "from(f in Fragment, select: g)", "from(f in Fragment, where: f.name == nil)", "System.halt(1)", "from(f in Fragment, limit: 0)",
])
def test_bad_queries(demo, bad):
    with pytest.raises(QueryError):
        demo.plan(bad)


def test_search_and_selectors(demo):
    hits = demo.search("Enum.map(_, _)").collect()
    assert len(hits) == 2 and all(h["score"] == 1.0 for h in hits)
    assert [h["name"] for h in demo.search(match.Selector("def _ do ... end", contains=["Map.get(_, _)"], lacks=["IO.puts(_)"])).collect()] == ["run"]
    assert [h["name"] for h in demo.search(match.Selector("def _ do ... end", comment="TODO")).collect()] == ["other"]
    deep = demo.search(match.Selector("Map.get(a, b)", deep=True, guards=[lambda b: b["a"].form == "list"]), limit=500).collect()
    assert deep and all(h["match_line"] == 4 for h in deep)
    pages, cursor = [], None
    while page := demo.search("_", limit=7, cursor=cursor).collect():
        pages += [(h["mass"], h["id"], h["match"]) for h in page]
        cursor = pages[-1]
    assert pages == [(h["mass"], h["id"], h["match"]) for h in demo.search("_", limit=1000).collect()]


def test_text(demo):
    (hit,) = demo.search_text("# TODO").collect()
    assert (hit["path"], hit["line"], hit["column"], hit["name"]) == ("lib/demo.ex", 9, 5, "other")
    assert [(h["line"], h["column"]) for h in demo.search_regex("(?i)# todo").collect()] == [(9, 5)]
    assert [h["path"] for h in demo.search_ranked("String.trim").collect()] == ["lib/both.ex"]
    (c,) = demo.search_comments("TODO").collect()
    assert c["text"] == "# TODO tidy"
    assert {r["qualified_name"] for r in demo.search_definitions("demo.").collect()} == {"Demo.run/1", "Demo.other/0"}
    assert {r["path"] for r in demo.search_references("enum.map").collect()} == {"lib/both.ex", "lib/demo.ex"}
    assert {r["caller_qualified_name"] for r in demo.search_callers("Enum.map/2").collect()} == {"Demo.run/1", "Both.run/1"}
    assert [r["callee_qualified_name"] for r in demo.search_callees("Both.other/1").collect()] == ["String.trim/1"]


def test_similarity_prefilter_equals_scan(spark, tmp_path):
    variants = [VARIANT, VARIANT.replace("items", "things"), VARIANT.replace("* 2", "* 3"), VARIANT.replace("  total * 2", "  x = total\n  x * 2"), "def far(a), do: a"]
    index = Index.build(spark, files.from_rows(spark, [(f"lib/v{i}.ex", v) for i, v in enumerate(variants)]), f"file://{tmp_path}/i", min_mass=5)
    for v in variants[:4]:
        a, b = ([(r["id"], round(r["similarity"], 9)) for r in index.similar(v, prefilter=p).collect()] for p in ("subhash", "scan"))
        assert a == b and a[0][1] == 1.0 and len(a) >= 3


def test_audit(spark, tmp_path):
    source = "defmodule A do\n  def f(x) do\n    x |> Enum.uniq() |> MapSet.new()\n    MapSet.new(Enum.uniq(x))\n    if length(x) == 0, do: true, else: false\n  end\nend\n"
    index = Index.build(spark, files.from_rows(spark, [("lib/a.ex", source)]), f"file://{tmp_path}/i", min_mass=1)
    checks = {"dedup": ["MapSet.new(Enum.uniq(_))"], "length": ["length(_) == 0"], "boolean": ["if _, do: true, else: false"]}
    for mode in ("exact", "anchor"):
        got = [(r["check"], r["line"]) for r in index.audit(checks, mode=mode).collect()]
        assert got == [("boolean", 5), ("dedup", 3), ("dedup", 4), ("length", 5)]
    assert "Enum.uniq" in index.audit(checks).where("check = 'dedup'").first()["snippet"]
    assert index.audit({"none": ["Absent.call(_)"]}).count() == 0


def test_hydration(demo):
    a = demo.hydrate("local", "demo", "1.0.0")
    assert [f["path"] for f in a.files] == ["lib/demo.ex"] and a.fingerprint == demo.hydrate("local", "demo", "1.0.0", include_ast=True).fingerprint
    with pytest.raises(ValueError, match="unsafe"):
        demo.hydrate("local", "demo", "1.0.0", ["../**"])
    for limits in ({"max_files": 0}, {"max_bytes": 1}, {"max_path_patterns": 0}):
        with pytest.raises(LimitError):
            demo.hydrate("local", "demo", "1.0.0", **limits)


def test_trees_stats_and_completion(demo):
    some = demo.search("Map.get(_, _)").first()["id"]
    rows = demo.tree_nodes(some).collect()
    assert rows[0]["pre"] == 1 and all(r["post"] >= r["pre"] for r in rows)
    assert demo.get(some).first()["path"] == "lib/demo.ex"
    assert demo.stats()["files"] == 3 and {r["kind"] for r in demo.kinds().collect()} >= {"def", "module", "expression"}
    assert {r["name"]: r["n"] for r in demo.package_counts().collect()}["bad"] == 0
    assert demo.complete("name", "R").first()["value"] == "run"
    assert demo.file_source("local", "both", "0.1.0", "lib/both.ex") == JOIN
    assert demo.explain("from(f in Fragment, where: matches(f, Map.get(_, _)))")["verified"] == 1


def test_indexing_again_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    rows = [("lib/a.ex", JOIN, {"version": "1.0.0"}), ("lib/a.ex", DEMO, {"version": "1.0.0"}), ("lib/b.ex", JOIN, {"version": "1.0.0"}), ("lib/a.ex", JOIN, {"version": "2.0.0"})]
    index = Index.build(spark, files.from_rows(spark, rows), root, min_mass=1)
    once = {t: sorted(map(str, index.table(t).collect())) for t in ("files", "fragments", "references", "call_edges", "package_versions", "terms")}
    Index.build(spark, files.from_rows(spark, rows), root, min_mass=1)
    again = Index.open(spark, root)
    assert {t: sorted(map(str, again.table(t).collect())) for t in once} == once
    counts = {r["package_version_id"]: r["count"] for r in index.table("files").groupBy("package_version_id").count().collect()}
    assert sorted(counts.values()) == [1, 2]
    assert index.store.pending().count() == 0
    done = spark.createDataFrame([("local", "local", "1.0.0"), ("local", "new", "1.0.0")], "ecosystem string, name string, version string")
    assert [r["name"] for r in index.store.resume(done).collect()] == ["new"]
    with pytest.raises(ValueError):
        index.store.remove_version(next(iter(counts)))
    index.store.cluster_postings(2)
    index.store.compact("packages")
    assert index.table("packages").count() == 1


def test_format_guard(spark, tmp_path):
    with pytest.raises(FormatError):
        Index.open(spark, f"file://{tmp_path}/none")
    store = Store(spark, f"file://{tmp_path}/old")
    spark.createDataFrame([(1, 99, 1)], "id long, format_version int, parser_version int").write.parquet(store.path("index_format"))
    with pytest.raises(FormatError):
        Index.open(spark, f"file://{tmp_path}/old")


def test_sharded_equals_single(spark, tmp_path):
    rows = [(f"lib/{n}.ex", JOIN.replace("Both", n.title()), {"name": n}) for n in ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot")]
    parts = [Index.build(spark, files.from_rows(spark, rows[i::2]), f"file://{tmp_path}/s{i}", min_mass=1) for i in range(2)]
    single, many = Index.build(spark, files.from_rows(spark, rows), f"file://{tmp_path}/one", min_mass=1), sharded(parts)
    pages = [names(many.all("from(p in Package)", skip=k, limit=2), "p") for k in (0, 2, 4)]
    assert sum(pages, []) == ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]
    q = "from(f in Fragment, where: matches(f, def run(_) do ... end))"
    assert many.count(q) == single.count(q) == 6
    assert [r["id"] for r in many.search("Enum.map(_, _)").collect()] == [r["id"] for r in single.search("Enum.map(_, _)").collect()]


def test_publish(spark, tmp_path):
    to = f"file://{tmp_path}/release"
    publish(spark, {"ok": 1, "error": 0}, {"shards": 1}, to)
    assert (tmp_path / "release/manifest.json").exists()
    with pytest.raises(ValueError):
        publish(spark, {"error": 2}, {}, to)


def test_lookup_of_enclosing_fragments(spark):
    spans = spark.createDataFrame([(1, 1, 20, 100), (2, 3, 7, 10), (3, 5, 5, 1), (4, 10, None, 5)], "id long, line int, end_line int, mass int").withColumn("f", F.lit(1))
    facts = spark.createDataFrame([(n, 1) for n in (1, 3, 5, 8, 10, 30)], "at int, g int")
    got = joins.smallest_enclosing(facts, spans, key=("g", "f"), start="line", end="end_line", point="at", fact_id="at", size=F.col("mass"), tie=F.col("id"))
    assert {r["at"]: r["id"] for r in got.collect()} == {1: 1, 3: 2, 5: 3, 8: 1, 10: 4, 30: 4}


def test_postings(spark):
    p = spark.createDataFrame([(3, 20), (1, 10), (2, 30), (1, 40), (2, 10)], "term_id long, fragment_id long")
    assert sorted(map(tuple, postings.clustered(p, 2).collect())) == sorted(map(tuple, p.collect()))
    for f in (postings.intersect, postings.intersect_by_semi_joins):
        assert [r[0] for r in f(p, "fragment_id", [1, 2], "term_id").collect()] == [10]
        assert f(p, "fragment_id", [1, 9], "term_id").count() == 0
    d = audits.diff(p, p.where("term_id > 1"), ["term_id", "fragment_id"])
    assert {r["status"]: r["count"] for r in d.groupBy("status").count().collect()} == {"removed": 2, "unchanged": 3}


def test_noise_is_told_by_name_and_arity():
    from codequarry.functions import code, elixir

    tree = elixir.parse("defmodule M do\n  alias A.B\n  def run(x) do\n    map(x, 1)\n    list(x, 2)\n    type(x)\n    other(x)\n    %User{name: :\\\\}\n  end\nend\n")
    _, refs, edges = code.symbols(tree)
    assert [r["qualified_name"] for r in refs if r["kind"] == "local_call"] == ["map/2", "list/2", "other/1"]
    assert [e["callee_qualified_name"] for e in edges] == ["M.map/2", "M.list/2", "M.other/1"]
    sets = code.symbol_sets(tree)
    assert (sets["defs"], sets["modules"], sets["functions"], sets["aliases"], sets["structs"]) == (["M", "run/1"], ["M"], ["run"], ["A.B"], ["User"])
    assert "\\\\" in sets["atoms"] and sets["refs"] == ["list/2", "map/2", "other/1"]
    assert code.generated("lib/a.ex", "# DO NOT EDIT\n") and code.generated("lib/x.pb.ex", "") and not code.generated("lib/a.ex", "# by hand\n")


def test_two_matches_on_one_line_are_two_findings(spark, tmp_path):
    source = "defmodule A do\n  def f(x) do\n    {IO.inspect(x), IO.inspect(1), IO.inspect(x)}\n  end\nend\n"
    ix = Index.build(spark, files.from_rows(spark, [("lib/a.ex", source)]), f"file://{tmp_path}/i", min_mass=1)
    found = ix.audit({"io": ["IO.inspect(_)"]}).collect()
    assert len(found) == 2 and len({r["fingerprint"] for r in found}) == 2 and {r["line"] for r in found} == {3}


def test_text_search_reads_postings_and_explains(demo):
    from codequarry.functions import text as T

    assert T.inner_words('label = "some label"') == ["some"] or "some" in T.inner_words('label = "some label"')
    assert T.inner_words("word") == [] and T.inner_words("a b-c d") == ["b", "c"]
    said = demo.explain_text('label = "some label"')
    assert said["strategy"] == "postings" and (said["files"], said["candidates"], said["verified"]) == (3, 1, 1)
    assert demo.explain_text("def")["strategy"] == "scan"
    assert demo.search_text('= "some label"').count() == 1 and demo.search_text("no such thing here").count() == 0
    like = demo.explain_similar("def other(s) do\n  String.trim(s)\nend")
    assert like["strategy"] == "subhash" and like["candidates"] <= like["fragments"] and like["verified"] >= 1
    e = demo.explain("from(f in Fragment, where: matches(f, def _ do ... end), where: contains(f, Enum.map(...)))")
    assert set(e["stages"]) == {"plan", "candidates", "verify"} and e["rejected"] == e["candidates"].value - e["verified"]


def test_callers_have_pages_and_versions_compact(demo, spark, tmp_path):
    every = [r["id"] for r in demo.search_callees("run").collect()]
    assert every == [r["id"] for k in range(len(every)) for r in demo.search_callees("run", skip=k, limit=1).collect()] and len(every) > 1
    rows = [(f"lib/{k}.ex", JOIN, {"name": n}) for k in range(3) for n in ("a", "b")]
    ix = Index.build(spark, files.from_rows(spark, rows), f"file://{tmp_path}/i", min_mass=1)
    before = sorted(map(str, ix.table("fragment_terms").collect()))
    ix.store.compact("fragment_terms", 1)
    assert sorted(map(str, ix.table("fragment_terms").collect())) == before
    ix.store.cluster_postings(2)
    assert sorted(map(str, ix.table("fragment_terms").select("term_id", "fragment_id", "package_version_id").collect())) == sorted(map(str, ix.spark.read.parquet(ix.store.path("fragment_terms")).select("term_id", "fragment_id", "package_version_id").collect()))
    assert "postings_by_term" in str(ix.table("fragment_terms").inputFiles())
