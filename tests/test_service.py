"""Requests, shards, reports and the command line, on small sources of our own."""

import json

import pytest

from codequarry import __main__ as cli
from codequarry import reports, service, shards
from codequarry.index import Index
from codequarry.sources import files

SOURCE = '''defmodule Shop.{name} do
  def total(items) do
    # sum them up
    Enum.reduce(items, 0, fn x, acc -> x + acc end)
  end

  def first(items) do
    List.first(items)
  end
end
'''
NAMES = ("Alpha", "Bravo", "Charlie", "Delta", "Echo")


@pytest.fixture(scope="module")
def rows():
    return [(f"lib/{n.lower()}.ex", SOURCE.replace("{name}", n), {"name": n.lower(), "version": "1.0.0"}) for n in NAMES]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return Index.build(spark, files.from_rows(spark, rows), f"file://{tmp_path_factory.mktemp('served')}", min_mass=1)


def test_modes_and_page_sizes():
    for pattern, mode in (("Repo.get!(_, _)", "structural"), ("def run", "structural"), ("fn x -> x end", "structural"), ("from(f in Fragment)", "structural"), ("call(...)", "structural"), ("plain words", "text"), ("users/:id", "text")):
        assert service.search_mode(None, pattern) == service.search_mode("auto", pattern) == mode
    assert service.search_mode("regex", "a_b") == "regex"
    assert [service.page_size(x) for x in (None, "7", 0, 10_000, "x")] == [50, 7, 1, 200, 50]


def test_search_pages(index):
    for request in ({"pattern": "def _ do ... end"}, {"pattern": "Enum.reduce(_, _, _)"}, {"pattern": "items", "mode": "text"}, {"pattern": "(?i)SUM|first", "mode": "regex"}, {"pattern": "from(f in Fragment, where: f.mass > 3)"}, {"pattern": 'contains(f, List.first(_))'}):
        whole = service.search(index, request | {"limit": 200})
        assert whole["next_cursor"] is None and whole["count"] == len(whole["results"]) > 0
        got, cursor = [], None
        for _ in range(60):
            page = service.search(index, request | {"limit": 7, "cursor": cursor})
            got += page["results"]
            if (cursor := page["next_cursor"]) is None:
                break
        assert got == whole["results"], request


def test_queries_and_plans(index):
    q = {"version": 1, "source": "file", "binding": "f", "predicates": [{"op": "prefix_search", "binding": "f", "field": "path", "value": "lib/"}], "joins": [], "select": None, "limit": 2}
    page = service.query(index, {"query": q})
    assert [r["f"]["path"] for r in page["results"]] == ["lib/alpha.ex", "lib/bravo.ex"]
    page = service.query(index, {"query": q, "cursor": page["next_cursor"]})
    assert [r["f"]["path"] for r in page["results"]] == ["lib/charlie.ex", "lib/delta.ex"]
    joined = service.query(index, {"query": 'from(f in Fragment, join: r in assoc(f, :references), where: r.name == "first", select: r)'})
    assert {tuple(r) for r in joined["results"]} == {("r",)} and {r["r"]["qualified_name"] for r in joined["results"]} == {"List.first/1"}
    planned = service.plan(index, {"query": q})
    assert planned["plan"]["execution"] == "entity" and planned["estimate"] == {"value": 5, "relation": "eq"}


@pytest.mark.parametrize("endpoint,params,status,code", [
    ("search", {"pattern": "(", "mode": "regex"}, 400, "invalid_search"), ("search", {"pattern": "def ) (", "mode": "structural"}, 400, "invalid_search"), ("query", {}, 400, "invalid_query"),
    ("query", {"query": "System.halt(0)"}, 400, "invalid_query"), ("query", {"query": {"version": 9, "source": "file", "binding": "f"}}, 400, "invalid_query"), ("plan", {"query": "from(f in File)"}, 400, "invalid_query"),
    ("hydrate", {"ecosystem": "local", "package_name": "absent", "version": "1"}, 404, "package_version_not_found"), ("hydrate", {}, 400, "invalid_hydration_request"),
    ("hydrate", {"ecosystem": "local", "package_name": "alpha", "version": "1.0.0", "paths": ["../x"]}, 400, "invalid_hydration_request"),
    ("hydrate", {"ecosystem": "local", "package_name": "alpha", "version": "1.0.0", "paths": ["a"] * 21}, 413, "snapshot_limit_exceeded"), ("nothing", {}, 404, "not_found"),
])
def test_errors(index, endpoint, params, status, code):
    got, body = service.call(index, endpoint, params)
    body = json.loads(body)
    assert got == status and body["version"] == 1 and body["error"]["code"] == code and body["error"]["message"]


def test_other_endpoints(index):
    snapshot = service.hydrate(index, {"ecosystem": "local", "package_name": "alpha", "version": "1.0.0"})
    assert [f["path"] for f in snapshot["files"]] == ["lib/alpha.ex"] and snapshot["complete"]
    assert "fragment" in service.capabilities()["sources"] and service.health(index)["status"] == "ok"
    assert len(service.packages(index)["packages"]) == 5 and service.stats(index)["counts"]["files"] == 5


def test_shards_by_manifest(spark, rows, index, tmp_path):
    many = shards.build(spark, files.from_rows(spark, rows), f"file://{tmp_path}/many", 3, min_mass=1)
    assert many.shard_count == 3 and sorted(p[1] for m in many.manifest for p in m["packages"]) == sorted(n.lower() for n in NAMES)
    again = shards.open_sharded(spark, f"file://{tmp_path}/many/manifest.json")
    for q in ("from(f in Fragment, where: matches(f, def _ do ... end))", "from(p in Package)", "from(f in File)"):
        assert again.count(q) == index.count(q)
    assert [r["id"] for r in again.search("Enum.reduce(_, _, _)").collect()] == [r["id"] for r in index.search("Enum.reduce(_, _, _)").collect()]
    (owner,) = many.owners("local", "echo")
    only = many.of("local", "echo", "1.0.0")
    assert [r["path"] for r in only.table("files").select("path").collect()] == ["lib/echo.ex"] or len(many.manifest[owner]["packages"]) > 1
    assert many.of("local", "absent").count("from(f in File)") == 0
    assert [(r["name"], r["n"] > 0) for r in many.package_counts().orderBy("name").collect()] == [(n.lower(), True) for n in NAMES]
    assert service.health(many)["shards"] == 3


def test_reports(spark):
    assert [reports.duration(s) for s in (0, 42.4, 187, 7500)] == ["0s", "42s", "3m07s", "2h05m"]
    t = reports.Timings()
    t.add("parse", 10)
    t.add("parse", 30)
    with t.stage("write"):
        pass
    assert t.snapshot()["parse"] == {"count": 2, "total": 40, "avg": 20, "max": 30} and t.snapshot()["write"]["count"] == 1
    out = spark.createDataFrame([("a", "1", "ok", None), ("b", "1", "error", "timeout"), ("c", "2", "skipped", None), ("a", "2", "error", "parse")], "name string, version string, status string, reason string")
    r = reports.run_report(out, 1200, {"shards": 2})
    assert (r["ok"], r["skipped"], r["error"]) == (1, 1, 2) and [f["name"] for f in r["failures"]] == ["a", "b"]
    both = reports.merged([r, r])
    assert both["error"] == 4 and len(both["failures"]) == 4
    have = spark.createDataFrame([("a", "1")], "name string, version string")
    assert reports.missing_tarballs(out.select("name", "version"), have).count() == 3
    hits = spark.createDataFrame([("p", "1", "x", 9, "b"), ("p", "1", "x", 2, "a"), ("q", "1", "y", 1, "c")], "package string, version string, path string, line int, what string")
    assert [(r["package"], [h["line"] for h in r["hits"]]) for r in reports.grouped_hits(hits).collect()] == [("p", [2, 9]), ("q", [1])]
    assert [tuple(r) for r in reports.counts_by(hits, "package").collect()] == [("p", 2), ("q", 1)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    for n in NAMES[:2]:
        (tmp_path / "src" / f"{n.lower()}.ex").write_text(SOURCE.replace("{name}", n))
    root = f"file://{tmp_path}/index"

    def run(*argv):
        code = cli.main([str(a) for a in argv])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    code, (made,) = run("index", root, tmp_path / "src", "--min-mass", 1)
    assert code == 0 and made["counts"]["files"] == 2
    assert len(run("search", root, "def _ do ... end", "--contains", "List.first(_)")[1]) == 2
    assert len(run("search", root, "def _ do ... end", "--not-contains", "List.first(_)")[1]) == 2
    assert {h["line"] for h in run("search", root, "sum them", "--text")[1]} == {3}
    assert len(run("query", root, "from(f in File)")[1]) == 2
    checks = tmp_path / "checks.json"
    checks.write_text(json.dumps({"first": ["List.first(_)"], "reduce": ["Enum.reduce(_, 0, _)"]}))
    assert [f["check"] for f in run("audit", root, checks, "--save", tmp_path / "saved")[1]] == ["first", "first", "reduce", "reduce"]
    assert run("audit", root, checks, "--group-by", "check")[1] == [{"value": "first", "n": 2}, {"value": "reduce", "n": 2}]
    assert len(run("audit", root, checks, "--sample", 3)[1]) == 3
    checks.write_text(json.dumps({"first": ["List.first(_)"], "sum": ["_ + _"]}))
    assert {r["status"]: r["count"] for r in run("audit", root, checks, "--diff", tmp_path / "saved")[1]} == {"new": 2, "removed": 2, "unchanged": 2}
    assert run("serve-request", root, "stats")[0] == 0 and run("serve-request", root, "query", "{}")[0] == 1
