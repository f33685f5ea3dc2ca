"""The library's front: build or open an index, and ask it.

All questions return DataFrames, unless their results are bounded by their arguments. Indexes are
advisory and the matcher decides: terms, kinds, names and scopes narrow the rows first, within the plan.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import code, elixir, match
from codequarry.functions import text as T
from codequarry.functions.locations import literal_locations, regex_locations
from codequarry.operators import audits, paging, postings
from codequarry.operators.joins import first_by, within
from codequarry.operators.store import Store
from codequarry.plans import compiler, dsl
from codequarry.plans.model import Estimate, Plan, Predicate, Query, QueryError, validate
from codequarry.plans.planner import plan as planned
from codequarry.ship import map_arrow

Q = str | dict | Query


@dataclass
class Snapshot:
    """A reproducible set of files: complete, or it was refused."""

    files: list[dict]
    fingerprint: str
    package: tuple[str, str, str]
    bytes: int


class LimitError(ValueError):
    def __init__(self, what: str, actual: int, limit: int):
        super().__init__(f"{what}: {actual} is more than {limit}")
        self.what, self.actual, self.limit = what, actual, limit


class Index:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.table = store.table

    @classmethod
    def build(cls, spark: SparkSession, sources: DataFrame, root: str, *, prefix: str = "", **options) -> Index:
        store = Store(spark, root, prefix)
        store.index(sources, **options)
        return cls(store)

    @classmethod
    def open(cls, spark: SparkSession, root: str, *, prefix: str = "") -> Index:
        store = Store(spark, root, prefix)
        store.check_format()
        return cls(store)

    # structured queries

    @staticmethod
    def query(q: Q) -> Query:
        return validate(q if isinstance(q, Query) else Query.from_map(q) if isinstance(q, dict) else dsl.parse_query(q))

    def plan(self, q: Q) -> Plan:
        return planned(self.query(q))

    def scope_ids(self, package: tuple[str, str] | None = None, version: tuple[str, str, str] | None = None) -> dict:
        """Ids of a package or version, by their names; one that isn't there has an id that no row has."""
        if version:
            return {"package_version_id": self._hash(*version)}
        return {"package_id": self._hash(*package)} if package else {}

    def _hash(self, *names: str) -> int:
        return self.spark.range(1).select(F.xxhash64(*[F.lit(x) for x in names])).first()[0]

    def all(self, q: Q, *, skip: int = 0, limit: int | None = None, cursor: Sequence | None = None, **scope) -> DataFrame:
        """Rows of a query, one struct a selected binding, in the source's order. cursor: the last row's mass and id."""
        plan = self.plan(q)
        rows = compiler.compile_plan(plan, self.table, **scope)
        order = compiler.order_of(plan)
        if cursor is not None:
            rows = rows.where(paging.after(order, cursor))
        most = plan.query.limit or limit or 50
        return compiler.selected(paging.page(rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]), skip, most), plan)

    def count(self, q: Q, **scope) -> int:
        return compiler.compile_plan(self.plan(q), self.table, **scope).count()

    def estimate(self, q: Q, most: int = paging.MAX_CANDIDATES, **scope) -> Estimate:
        """How many candidates the scan and the postings leave, before the matcher."""
        plan = self.plan(q)
        plan.structural = []
        r = paging.bounded_count(compiler.compile_plan(plan, self.table, **scope), most).first()
        return Estimate(r["value"], r["relation"])

    def search(self, pattern: str | match.Selector, *, skip: int = 0, limit: int = 50, cursor: Sequence | None = None, **scope) -> DataFrame:
        """Structural search: fragment, the match's place and number within it, score, in order of mass, id and match.

        cursor: mass, id and match of the last row.
        """
        selector = pattern if isinstance(pattern, match.Selector) else match.Selector(pattern)
        rows = compiler.scope(self.table("fragments"), **scope)
        if not selector.deep:
            kind, name, arity = match.pushdown(match.compiled(selector.pattern))
            for c, v in (("kind", kind), ("name", name), ("arity", arity)):
                rows = rows if v is None else rows.where(F.col(c) == v)
        rows = compiler.with_terms(rows, self.table, sorted(selector.terms()))
        if selector.comment is not None:
            files = self.table("files").select(F.col("id").alias("f_id"), "source")
            rows = rows.join(files, F.col("file_id") == F.col("f_id")).withColumn("lines", T.line_slice(F.col("source"), F.col("line"), F.greatest(F.col("last_line"), F.col("line")))).drop("f_id", "source")
        else:
            rows = rows.withColumn("lines", F.lit(None).cast("string"))
        names = ["id", "package_version_id", "file_id", "kind", "module", "name", "arity", "line", "end_line", "mass"]

        def run(batches):
            for b in batches:
                take, number, line = [], [], []
                for i, (ast, lines) in enumerate(zip(b.column("ast").to_pylist(), b.column("lines").to_pylist())):
                    for k, (n, _) in enumerate(selector.matches(elixir.decode(json.loads(ast)), lines)):
                        take.append(i)
                        number.append(k)
                        line.append(getattr(n, "line", None) or None)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(take, pa.int64())) for c in names), pa.array(number, pa.int32()), pa.array(line, pa.int32())], [*names, "match", "match_line"])

        rows = rows.select(*names, "ast", "lines")
        out = map_arrow(rows, run, "id long, package_version_id long, file_id long, kind string, module string, name string, arity int, line int, end_line int, mass int, match int, match_line int")
        keys = ["mass", "id", "match"]
        if cursor is not None:
            out = out.where(paging.after(keys, cursor))
        return paging.page(out.orderBy(*keys), skip, limit).withColumn("score", F.lit(1.0))

    def explain(self, q: Q) -> dict:
        """The plan, what each step leaves and how long it took in milliseconds, and how many candidates the matcher rejected."""
        stages: dict[str, float] = {}

        def timed(name, f):
            began = time.perf_counter()
            out = f()
            stages[name] = round(1000 * (time.perf_counter() - began), 3)
            return out

        plan = timed("plan", lambda: self.plan(q))
        candidates = timed("candidates", lambda: self.estimate(q))
        rows = compiler.compile_plan(plan, self.table)
        verified = timed("verify", rows.count)
        return {
            "plan": plan, "required_terms": plan.required_terms, "candidates": candidates, "verified": verified, "stages": stages,
            "rejected": candidates.value - verified if candidates.relation == "eq" else None, "physical": rows._jdf.queryExecution().toString(),
        }

    def explain_text(self, literal: str, **scope) -> dict:
        """How a literal is searched: words that the postings narrow the files by, and files before, after that, and with the literal."""
        words, files = T.inner_words(literal), compiler.scope(self.table("files"), **scope)
        left = self._holding(files, words)
        return {"strategy": "postings" if words else "scan", "words": words, "files": files.count(), "candidates": left.count(), "verified": left.where(F.col("source").contains(literal)).count()}

    def explain_similar(self, source: str, *, min_similarity: float = 0.8, prefilter: str = "auto", **scope) -> dict:
        """How similar fragments are searched: strategy, mass and sub-trees of the query, fragments before and after the filter, and results."""
        mine, rows, strategy = self._similar_candidates(source, min_similarity, prefilter, scope)
        found = self.similar(source, min_similarity=min_similarity, limit=paging.MAX_CANDIDATES, prefilter=prefilter, **scope).count()
        total = compiler.scope(self.table("fragments"), **scope).count()
        return {"strategy": strategy, "mass": mine["mass"], "sub_trees": len(mine["sub_hashes"]), "fragments": total, "candidates": rows.count(), "verified": found}

    # text

    def _fragment_at(self, files: DataFrame, mode: str) -> DataFrame:
        """files (file_id, path, line, ...) with the fragment of each line: the smallest around it, or the file's first."""
        f = self.table("fragments").select(F.col("id").alias("fragment_id"), F.col("file_id").alias("f_file"), "kind", "module", "name", "arity", F.col("line").alias("f_line"), F.coalesce("end_line", "last_line").alias("f_end"), "mass", "ordinal")
        if mode == "first":
            f = first_by(f, ["f_file"], [F.col("f_line"), F.col("ordinal"), F.col("fragment_id")]).drop("ordinal")
            return files.join(f, F.col("file_id") == F.col("f_file"), "left").drop("f_file", "f_line", "f_end")
        joined = files.join(f, (F.col("file_id") == F.col("f_file")) & within(F.col("line"), F.col("f_line"), F.col("f_end")), "left")
        return first_by(joined, ["file_id", "line", "column"], [F.col("mass").asc_nulls_last(), F.col("fragment_id")]).drop("f_file", "f_line", "f_end", "ordinal")

    def _located(self, rows: DataFrame, function, value: str, skip: int, limit: int, mode: str) -> DataFrame:
        def run(batches):
            for b in batches:
                take, line, column = [], [], []
                for i, source in enumerate(b.column("source").to_pylist()):
                    for at_line, at_column in function(source, value):
                        take.append(i)
                        line.append(at_line)
                        column.append(at_column)
                rows = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("file_id").take(rows), b.column("path").take(rows), pa.array(line, pa.int32()), pa.array(column, pa.int32())], ["file_id", "path", "line", "column"])

        places = map_arrow(rows.select(F.col("id").alias("file_id"), "path", "source"), run, "file_id long, path string, line int, column int")
        page = paging.page(places.orderBy("path", "file_id", "line", "column"), skip, limit)
        return self._fragment_at(page, mode).orderBy("path", "file_id", "line", "column")

    def search_text(self, literal: str, *, skip: int = 0, limit: int = 50, mode: str = "smallest", **scope) -> DataFrame:
        """Places of a literal, case-sensitive, with the fragment around each (mode "first": the file's first fragment)."""
        rows = self._holding(compiler.scope(self.table("files"), **scope), T.inner_words(literal)).where(F.col("source").contains(literal))
        return self._located(rows, literal_locations, literal, skip, limit, mode)

    def _holding(self, files: DataFrame, words: Sequence[str]) -> DataFrame:
        """Files that have all words, by the stored postings, so that other sources needn't be read; all files if no word is asked for."""
        if not words:
            return files
        ids = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
        hit = postings.intersect(self.table("file_terms"), "file_id", ids, "term_id").withColumnRenamed("file_id", "h_id")
        return files.join(hit, F.col("id") == F.col("h_id"), "left_semi")

    def search_regex(self, pattern: str, *, skip: int = 0, limit: int = 50, mode: str = "smallest", **scope) -> DataFrame:
        """Places of a regular expression; flags are written within it, as (?i). It must be one in Java and in Python."""
        try:
            self.spark._jvm.java.util.regex.Pattern.compile(pattern)
            re.compile(pattern)
        except (Py4JJavaError, re.error) as e:
            raise QueryError(f"not a regular expression: {pattern!r}") from e
        rows = compiler.scope(self.table("files"), **scope).where(F.col("source").rlike(pattern))
        return self._located(rows, regex_locations, pattern, skip, limit, mode)

    def search_ranked(self, text: str, *, limit: int = 50, **scope) -> DataFrame:
        """Files by BM25 of the text's identifier tokens, best first, ties by path."""
        tokens = [t for t in self.spark.range(1).select(T.identifier_tokens(F.lit(text))).first()[0].split(" ") if t]
        ids = [r[0] for r in self.spark.createDataFrame([(t,) for t in tokens], "t string").select(F.xxhash64("t")).collect()]
        post = compiler.scope(self.table("file_terms"), **scope).select("term_id", "file_id", "tf")
        lengths = compiler.scope(self.table("file_lengths"), **scope).select("file_id", "len")
        scored = postings.bm25(post, lengths, ids, "file_id", term="term_id")
        paths = compiler.scope(self.table("files"), **scope).select(F.col("id").alias("f_id"), "path")
        return paging.page(scored.join(paths, F.col("file_id") == F.col("f_id")).select("file_id", "score", "path").orderBy(F.desc("score"), "path"), 0, limit)

    def search_comments(self, literal: str, *, skip: int = 0, limit: int = 50, **scope) -> DataFrame:
        rows = compiler.scope(self.table("comments"), **scope).where(F.col("text").contains(literal))
        files = self.table("files").select(F.col("id").alias("f_id"), "path")
        return paging.page(rows.join(files, F.col("file_id") == F.col("f_id")).drop("f_id").orderBy("path", F.col("line").asc_nulls_last(), "id"), skip, limit)

    def _facts(self, table: str, name: str, skip: int, limit: int, scope: dict) -> DataFrame:
        rows = compiler.scope(self.table(table), **scope).where(T.icontains(F.col("qualified_name"), name))
        files = self.table("files").select(F.col("id").alias("f_id"), "path")
        return paging.page(rows.join(files, F.col("file_id") == F.col("f_id"), "left").drop("f_id").orderBy("qualified_name", F.col("line").asc_nulls_last(), "id"), skip, limit)

    def search_definitions(self, name: str, *, skip: int = 0, limit: int = 50, **scope) -> DataFrame:
        return self._facts("definitions", name, skip, limit, scope)

    def search_references(self, name: str, *, skip: int = 0, limit: int = 50, **scope) -> DataFrame:
        return self._facts("references", name, skip, limit, scope)

    def _edges(self, column: str, name: str, skip: int, limit: int, scope: dict) -> DataFrame:
        c = F.col(column)
        rows = compiler.scope(self.table("call_edges"), **scope).where((c == name) | T.icontains(c, name))
        return paging.page(rows.withColumn("score", F.lit(1.0)).orderBy(F.col("file_id").asc_nulls_last(), F.col("line").asc_nulls_last(), "id"), skip, limit)

    def search_callers(self, name: str, *, skip: int = 0, limit: int = 50, **scope) -> DataFrame:
        """Edges whose callee is called so."""
        return self._edges("callee_qualified_name", name, skip, limit, scope)

    def search_callees(self, name: str, *, skip: int = 0, limit: int = 50, **scope) -> DataFrame:
        """Edges whose caller is called so."""
        return self._edges("caller_qualified_name", name, skip, limit, scope)

    # similarity

    def similar(self, source: str, *, min_similarity: float = 0.8, limit: int = 20, prefilter: str = "auto", **scope) -> DataFrame:
        """Fragments like the source's largest one: similarity (tree edit), overlap of sub-trees; best first.

        prefilter "subhash" keeps fragments within half and double the mass that share a sub-tree, "scan" takes
        all, "auto" takes the former from a similarity of 0.8 on.
        """
        mine, rows, _ = self._similar_candidates(source, min_similarity, prefilter, scope)
        hashes = F.array(*[F.lit(h) for h in mine["sub_hashes"]]).cast("array<long>")
        rows = rows.select("id", "file_id", "kind", "module", "name", "arity", "line", "mass", F.size(F.array_intersect("sub_hashes", hashes)).alias("overlap"), "ast")
        ast = mine["ast"]

        def run(batches):
            query = elixir.decode(json.loads(ast))
            for b in batches:
                s = [match.similarity(query, elixir.decode(json.loads(a)), min_similarity) for a in b.column("ast").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "similarity"])

        out = map_arrow(rows, run, "id long, file_id long, kind string, module string, name string, arity int, line int, mass int, overlap int, similarity double")
        return paging.page(out.where(F.col("similarity") >= min_similarity).orderBy(F.desc("similarity"), F.desc("overlap"), "id"), 0, limit)

    def _similar_candidates(self, source: str, min_similarity: float, prefilter: str, scope: dict) -> tuple[dict, DataFrame, str]:
        """The source's largest fragment, the fragments to compare it with, and the strategy that chose them."""
        found = code.extract("query.ex", source, min_mass=1)
        if not found or not found["fragments"]:
            raise QueryError("the source has no fragment")
        mine = max(found["fragments"], key=lambda f: (f["mass"], -f["ordinal"]))
        rows = compiler.scope(self.table("fragments"), **scope)
        if prefilter != "subhash" and not (prefilter == "auto" and min_similarity >= 0.8 and mine["sub_hashes"]):
            return mine, rows, "scan"
        hashes = F.array(*[F.lit(h) for h in mine["sub_hashes"]]).cast("array<long>")
        return mine, rows.where((F.col("mass") >= mine["mass"] // 2) & (F.col("mass") <= 2 * mine["mass"]) & F.arrays_overlap("sub_hashes", hashes)), "subhash"

    # audits

    def audit(self, checks: dict[str, Sequence[str]], *, limit: int | None = None, most_df: int = 10_000, mode: str = "exact", **scope) -> DataFrame:
        """Findings of many patterns at once, one row a match: check, kind, package_version_id, file, line, message, fingerprint, snippet.

        checks: messages by their patterns. Candidates have all terms of some pattern (mode "exact") or the rarest
        one of it (mode "anchor", in which patterns with a commoner anchor than most_df are left out).
        """
        flat = [(check, p) for check, patterns in sorted(checks.items()) for p in patterns]
        wanted = [(str(i), t) for i, (_, p) in enumerate(flat) for t in sorted(match.required_terms(match.compiled(p)))]
        rows = compiler.scope(self.table("fragments"), **scope).where("kind = 'expression'")
        open_ = [i for i in range(len(flat)) if str(i) not in {g for g, _ in wanted}]
        post = self.table("fragment_terms")
        if wanted:
            groups = self.spark.createDataFrame(wanted, "`group` string, term string").select("group", F.xxhash64("term").alias("term_id"))
            if mode == "anchor":
                asked = post.join(F.broadcast(groups.select("term_id").distinct()), "term_id", "left_semi")  # as many terms as the patterns have
                marks = postings.anchors(postings.document_frequency(asked, "fragment_id", "term_id"), groups, "term_id", most_df)
                hit = post.join(F.broadcast(marks.select("group", "term_id")), "term_id").select("fragment_id", "group").distinct()
            else:
                hit = postings.containing_groups(post, groups, "fragment_id", "term_id").select("fragment_id", "group")
            hit = hit.groupBy("fragment_id").agg(F.collect_set(F.col("group").cast("int")).alias("groups"))  # bounded by the patterns
            rows = rows.join(hit, F.col("id") == F.col("fragment_id"), "left" if open_ else "inner").drop("fragment_id")
        else:
            rows = rows.withColumn("groups", F.array().cast("array<int>"))
        files = self.table("files").select(F.col("id").alias("f_id"), "path", "source")
        rows = rows.select("id", "file_id", "package_version_id", "line", "mass", "exact_hash", "ast", "groups")

        def run(batches):
            rules = [match.compiled(p) for _, p in flat]
            for b in batches:
                take, which = [], []
                for i, (ast, groups) in enumerate(zip(b.column("ast").to_pylist(), b.column("groups").to_pylist())):
                    tree = match.compiled(elixir.decode(json.loads(ast)))
                    for g in sorted({*(groups or []), *open_}):
                        if match.match(rules[g], tree) is not None:
                            take.append(i)
                            which.append(g)
                rows_ = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(c).take(rows_) for c in ("id", "file_id", "package_version_id", "line", "mass", "exact_hash")] + [pa.array([flat[g][0] for g in which], pa.string()), pa.array([flat[g][1] for g in which], pa.string())], ["id", "file_id", "package_version_id", "line", "mass", "fingerprint", "check", "message"])

        found = map_arrow(rows, run, "id long, file_id long, package_version_id long, line int, mass int, fingerprint string, check string, message string")
        # two matches on one line are two findings unless their code is the same
        found = audits.dedup(found, ["check", "message", "package_version_id", "file_id", "line", "fingerprint"], [F.col("mass"), F.col("id")])
        out = found.join(files, F.col("file_id") == F.col("f_id")).select("id", "check", F.lit("pattern").alias("kind"), "package_version_id", F.col("path").alias("file"), "line", "message", "fingerprint", T.snippet(F.col("source"), F.col("line")).alias("snippet"))
        out = out.orderBy("check", "file", F.col("line").asc_nulls_last(), "message", "id")
        return out if limit is None else out.limit(limit)

    # snapshots, trees, counts

    def hydrate(self, ecosystem: str, name: str, version: str, paths: Sequence[str] = ("lib/**",), *, max_files: int = 500, max_bytes: int = 10 << 20, max_path_patterns: int = 20, include_ast: bool = False) -> Snapshot:
        """A version's files by globs, whole or not at all. Absolute paths lose what they have in common."""
        if len(paths) > max_path_patterns:
            raise LimitError("path patterns", len(paths), max_path_patterns)
        wanted = "|".join(T.glob_regex(p) for p in paths)
        vid = self._hash(ecosystem, name, version)
        rows = self.table("files").where(F.col("package_version_id") == vid)
        if rows.where(F.col("path").startswith("/")).limit(1).count():
            tops = [r["p"] for r in rows.select(F.regexp_extract("path", r"^(.*?)/(?:lib|test|priv|src|config)/", 1).alias("p")).distinct().limit(2).collect()]
            cut_at = len(tops[0]) + 1 if len(tops) == 1 else 1
            rows = rows.withColumn("path", F.substring("path", cut_at + 1, 1_000_000))
        rows = rows.where(F.col("path").rlike(wanted))
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("b")).first()
        for what, actual, most in (("files", size["n"], max_files), ("bytes", size["b"], max_bytes)):
            if actual > most:
                raise LimitError(what, actual, most)
        columns = ["path", "source", "sha256", *(["ast"] if include_ast else [])]
        files = [r.asDict() for r in rows.select(*columns).orderBy("path").collect()]  # within the limits
        digest = hashlib.sha256("\n".join(f"{f['path']}:{f['sha256']}" for f in files).encode()).hexdigest()
        return Snapshot(files, digest, (ecosystem, name, version), size["b"])

    def tree_nodes(self, fragment_id: int) -> DataFrame:
        """The nodes of a fragment's tree, with pre- and post-order numbers."""
        rows = self.table("fragments").where(F.col("id") == fragment_id).select("ast")
        names = ["pre", "post", "depth", "role", "kind", "label", "line"]

        def run(batches):
            for b in batches:
                for ast in b.column("ast").to_pylist():
                    found = code.tree_rows(elixir.decode(json.loads(ast)))
                    kinds = [pa.int32()] * 3 + [pa.string()] * 3 + [pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)], names)

        return map_arrow(rows, run, "pre int, post int, depth int, role string, kind string, label string, line int").orderBy("pre")

    def get(self, fragment_id: int) -> DataFrame:
        f = self.table("files").select(F.col("id").alias("f_id"), "path", "source")
        return F.broadcast(self.table("fragments").where(F.col("id") == fragment_id)).join(f, F.col("file_id") == F.col("f_id")).drop("f_id").limit(1)

    def file_source(self, ecosystem: str, name: str, version: str, path: str) -> str | None:
        vid = self._hash(ecosystem, name, version)
        rows = self.table("files").where((F.col("package_version_id") == vid) & (F.col("path") == path)).select("source").limit(1).collect()
        return rows[0][0] if rows else None

    def stats(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in ("packages", "package_versions", "files", "fragments", "definitions", "references", "comments", "call_edges", "terms")}

    def kinds(self) -> DataFrame:
        return self.table("fragments").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files")).orderBy(F.desc("n"), "kind")

    def package_counts(self) -> DataFrame:
        """Packages with the number of their fragments, zero too, most first."""
        n = self.table("fragments").groupBy("package_id").agg(F.count("*").alias("n"))
        return self.table("packages").join(n, F.col("id") == F.col("package_id"), "left").select("id", "ecosystem", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "name")

    def complete(self, field: str, prefix: str, limit: int = 15) -> DataFrame:
        """Completions of a fragment's module or name, or a symbol's qualified name, by how often they occur."""
        table, column = {"module": ("fragments", "module"), "name": ("fragments", "name"), "definition": ("definitions", "qualified_name"), "reference": ("references", "qualified_name"), "path": ("files", "path")}[field]
        c = F.col(column)
        return paging.page(self.table(table).where(c.isNotNull() & T.prefix_ilike(c, prefix)).groupBy(c.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value"), 0, limit)


def contains(binding: str, text: str) -> Predicate:
    return Predicate("contains", binding, text)


def sharded(indexes: Sequence[Index]) -> Index:
    """One index over the union of several; order and limits then hold over all of them."""
    first = indexes[0]
    both = Index(first.store)
    both.table = lambda name: _union([i.store.table(name) for i in indexes])
    return both


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def shard_of(ordinal: Column, n: int) -> Column:
    return F.pmod(ordinal, F.lit(n))
