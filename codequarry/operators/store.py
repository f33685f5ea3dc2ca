"""An index on disk: Parquet datasets, one row a source with all its facts, in a partition a version; tables of facts are read from those rows.

Every id is a hash of a natural key, so tasks and runs that are repeated write the same rows,
and indexing a version again replaces its partition and nothing else.
"""

from __future__ import annotations

import gc
import hashlib
import json
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import schema
from codequarry.functions import code, text
from codequarry.operators.joins import first_by
from codequarry.ship import map_arrow

_SYMBOL = "kind string, module string, name string, arity int, qualified_name string, line int, `column` int"
#: Fields of what one source gives, by kind.
FACTS = {
    "fragments": "ordinal int, kind string, module string, name string, arity int, line int, end_line int, last_line int, mass int, exact_hash string, sub_hashes array<bigint>, terms array<string>, ast string",
    "definitions": _SYMBOL, "references": _SYMBOL, "comments": "text string, line int, `column` int",
    "edges": "caller string, callee string, module string, name string, arity int, external boolean, line int, `column` int",
}
#: The same as they are stored, a list a field: terms are places in the source's list of terms, an owner is a place in its list of fragments, a tree is a piece of the file's.
_STORED = {k: v.replace("terms array<string>, ast string", "terms array<int>, ast_at int, ast_size int") + ("" if k == "fragments" else ", owner int") for k, v in FACTS.items()}
_FIELDS = {k: {f.split()[0].strip("`"): f.split()[1] for f in v.split(", ")} for k, v in _STORED.items()}
_KEYS = "package_id long, package_version_id long, file_id long, path string, source string"
#: What one source gives: a row with all its facts. The tables of facts are read from it.
PARSED = f"{_KEYS}, ast string, identifier_tokens string, n_words int, words array<string>, word_counts array<int>, terms array<string>, " + ", ".join(f"{k}_{f} array<{t}>" for k, v in _FIELDS.items() for f, t in v.items())
STORED = f"{PARSED}, ids array<bigint>, term_ids array<bigint>, sha256 string"
#: Tables that are read from sources' rows until a copy of them is stored.
VIEWS = ("files", "file_lengths", "fragments", "fragment_terms", "comments", "definitions", "references", "graph_nodes", "call_edges")
#: Sources whose facts are held at once by a task.
STEP = 500
#: Versions whose files a task writes side by side; rows of more are sorted by version first.
WRITERS = 8


class FormatError(RuntimeError):
    pass


#: Names that fields of edges have before they are rows.
_EDGE = {"caller": "caller_qualified_name", "callee": "callee_qualified_name", "module": "callee_module", "name": "callee_name", "arity": "callee_arity"}


def edge_row(e: dict) -> dict:
    return {n: e[_EDGE.get(n, n)] for n in ("caller", "callee", "module", "name", "arity", "external", "line", "column")}


def parts(spark: SparkSession) -> int:
    """Into how many parts sources are dealt before they are parsed: a few for each core, however few bytes they have."""
    return 4 * spark.sparkContext.defaultParallelism


def stage(batches, min_mass: int, generated_min_mass: int | None):
    """Batches of sources with all their facts; of fragments with the same text on the same line of a file the first is kept."""
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    passed = [f.split()[0] for f in _KEYS.split(", ")]
    names = [f.split()[0] for f in PARSED.split(", ")]

    def offsets(lists: list) -> pa.Array:
        return pa.array([0, *accumulate(map(len, lists))], pa.int32())

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        asts, terms, counts, facts = [], [], [], {k: [] for k in FACTS if k != "fragments"}
        fragments = {n: [] for n in code.COLUMNS}
        sources = b.column("source").to_pylist()
        for path, source in zip(b.column("path").to_pylist(), sources):
            got = code.columns(path, source, fragments, min_mass=min_mass, generated_min_mass=generated_min_mass)
            if got is None:
                asts.append(None)
                terms.append([])
                counts.append(0)
                for rows in facts.values():
                    rows.append([])
                continue
            for k, lists in facts.items():
                lists.append(got[k])
            counts.append(got["fragments"])
            asts.append(got["ast"])
            terms.append(got["terms"])
        words = [text.word_counts(x) for x in sources]
        columns = [b.column(n) for n in passed]
        columns += [pa.array(asts, pa.string()), pa.array([text.identifier_tokens_of(x) for x in sources], pa.string()), pa.array([sum(x.values()) for x in words], pa.int32())]
        at = offsets(words)
        columns += [pa.ListArray.from_arrays(at, pa.array([w for x in words for w in x], pa.string())), pa.ListArray.from_arrays(at, pa.array([n for x in words for n in x.values()], pa.int32()))]
        columns.append(pa.array(terms, pa.list_(pa.string())))
        at = pa.array([0, *accumulate(counts)], pa.int32())
        columns += [pa.ListArray.from_arrays(at, pa.array(fragments[n], types[t])) for n, t in _FIELDS["fragments"].items()]
        for k, lists in facts.items():
            at, flat = offsets(lists), [r for rows in lists for r in rows]
            columns += [pa.ListArray.from_arrays(at, pa.array(list(map(itemgetter(_EDGE.get(n, n) if k == "edges" else n), flat)), types[t])) for n, t in _FIELDS[k].items()]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            # trees hold no circles: looking for them takes a fifth of the time
            looking = gc.isenabled()
            gc.disable()
            try:
                found = step(batch.slice(at, STEP))
            finally:
                if looking:
                    gc.enable()
            yield found


def checksums(hashes: DataFrame) -> DataFrame:
    """package_version_id, checksum: SHA-256 of a version's sorted file hashes, joined. A version's rows are read one after the other, never held at once."""

    def run(batches):
        now, digest = None, None
        for b in batches:
            done = []
            for vid, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest is None or vid != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = vid, hashlib.sha256()
                digest.update((h or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], ["package_version_id", "checksum"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["package_version_id", "checksum"])

    return map_arrow(hashes.repartition("package_version_id").sortWithinPartitions("package_version_id", "h"), run, "package_version_id long, checksum string")


class Store:
    """Tables below root; prefix lets several indexes share it."""

    def __init__(self, spark: SparkSession, root: str, prefix: str = ""):
        self.spark, self.root, self.prefix = spark, root.rstrip("/"), f"{prefix}_" if prefix else ""

    def path(self, table: str) -> str:
        return f"{self.root}/{self.prefix}{table}"

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        """A table's rows; none if it was never written. Facts come from a stored copy of the table if there is one, else from sources' rows; postings from their copy in ranges of terms."""
        if name == "fragment_terms" and self._exists("postings_by_term"):
            return self.spark.read.schema(schema.TABLES[name]).parquet(self.path("postings_by_term"))
        if self._exists(name):
            return self.spark.read.schema(schema.TABLES[name]).parquet(self.path(name))
        if name in (*VIEWS, "terms") and self._exists("facts"):
            rows = self._view(name, self.spark.read.schema(STORED).parquet(self.path("facts")))
            return rows.select(*sorted(rows.columns, key=lambda c: c == "package_version_id"))  # in the order of a stored copy
        return self.spark.createDataFrame([], schema.TABLES[name])

    def _view(self, name: str, got: DataFrame) -> DataFrame:
        """A table's rows from the rows of sources. Only the lists of fields that are asked for are read."""
        c = F.col
        nothing = F.lit(None).cast("map<string,string>")
        scope = ["package_id", "package_version_id", "file_id"]
        if name == "files":
            return got.select(c("file_id").alias("id"), "package_id", "package_version_id", "path", "source", "ast", F.array_join("comments_text", "\n").alias("comments_text"), "identifier_tokens", "sha256")
        if name == "file_lengths":
            return got.select(*scope, c("n_words").alias("len"))
        if name == "terms":
            return got.select(F.explode("terms").alias("term")).distinct().select(F.xxhash64("term").alias("id"), "term")
        if name == "fragment_terms":
            # a fragment has each of its terms once, so that no distinct is needed
            post = got.select("package_version_id", "term_ids", "ids", F.posexplode("fragments_terms").alias("pos", "places"))
            post = post.select("package_version_id", "term_ids", c("ids")[c("pos")].alias("fragment_id"), F.explode("places").alias("place"))
            return post.select(c("term_ids")[c("place")].alias("term_id"), "fragment_id", "package_version_id")

        def facts(kind: str, id_name: str) -> DataFrame:
            lists = [f"{kind}_{f}" for f in _FIELDS[kind]]
            x = got.select(*scope, "path", "ast", "ids", *lists, F.posexplode(f"{kind}_line").alias("pos", "at"))
            fields = {f: c(f"{kind}_{f}")[c("pos")] for f in _FIELDS[kind]}
            if kind == "fragments":
                whole = fields.pop("ast_at"), fields.pop("ast_size")
                digest = F.sha2(_natural(fields["line"], fields["exact_hash"]), 256)
                tree = F.substring(c("ast").cast("binary"), whole[0] + 1, whole[1]).cast("string")
                return x.select(c("ids")[c("pos")].alias("id"), *scope, *[v.alias(f) for f, v in fields.items()], digest.alias("content_hash"), tree.alias("ast"))
            owner = fields.pop("owner")
            return x.select(F.xxhash64(F.lit(id_name), "file_id", "pos").alias("id"), *scope, F.when(owner.isNotNull(), c("ids")[owner]).alias("fragment_id"), *[v.alias(f) for f, v in fields.items()])

        if name not in ("graph_nodes", "call_edges"):
            return facts(name, name).select(*[f"`{n}`" for n in _columns(name)])
        edges = facts("edges", "edges").withColumn("metadata", nothing)
        node = lambda q: F.xxhash64(F.lit("node"), "package_version_id", q)
        if name == "call_edges":
            return edges.select("id", *scope, node("caller").alias("caller_node_id"), node("callee").alias("callee_node_id"), c("fragment_id").alias("call_site_fragment_id"), c("caller").alias("caller_qualified_name"), c("callee").alias("callee_qualified_name"), "line", "column", "metadata")
        callers = edges.select(*scope, c("caller").alias("qualified_name"), F.lit("function").alias("kind"))
        callees = edges.select("package_id", "package_version_id", F.lit(None).cast("long").alias("file_id"), c("callee").alias("qualified_name"), F.when(c("external"), "external_function").otherwise("function").alias("kind"), "module", "name", "arity")
        defined = facts("definitions", "definitions").where(c("kind").startswith("def")).select("package_version_id", "qualified_name", c("fragment_id"), c("module").alias("d_module"), c("name").alias("d_name"), c("arity").alias("d_arity"), "line", "column").dropDuplicates(["package_version_id", "qualified_name"])
        nodes = callers.unionByName(callees, allowMissingColumns=True)
        nodes = nodes.groupBy("package_id", "package_version_id", "qualified_name").agg(F.max("file_id").alias("file_id"), F.min(F.when(c("kind") == "function", "function")).alias("f"), F.max("module").alias("module"), F.max("name").alias("name"), F.max("arity").alias("arity"))
        return nodes.join(defined, ["package_version_id", "qualified_name"], "left").select(
            F.xxhash64(F.lit("node"), "package_version_id", "qualified_name").alias("id"), "package_id", "package_version_id", "file_id", "fragment_id", F.lit("syntax").alias("engine"), c("qualified_name").alias("external_id"),
            F.coalesce("f", F.lit("external_function")).alias("kind"), F.coalesce("d_module", "module").alias("module"), F.coalesce("d_name", "name").alias("name"), F.coalesce("d_arity", "arity").alias("arity"), "qualified_name", "line", "column", nothing.alias("metadata"),
        )

    def check_format(self) -> None:
        rows = self.table("index_format").collect()
        if not rows or (rows[0]["format_version"], rows[0]["parser_version"]) != (schema.FORMAT_VERSION, schema.PARSER_VERSION):
            raise FormatError(f"{self.root} is no index of format {schema.FORMAT_VERSION}")

    def create(self) -> None:
        if self._exists("index_format"):
            return self.check_format()
        rows = [(1, schema.FORMAT_VERSION, schema.PARSER_VERSION)]
        self.spark.createDataFrame(rows, schema.TABLES["index_format"]).coalesce(1).write.parquet(self.path("index_format"))

    def _append_new(self, table: str, rows: DataFrame) -> None:
        """Rows whose id the table lacks. Ids are hashes of natural keys."""
        new = rows.select(*[c.split()[0] for c in _columns(table)]).dropDuplicates(["id"])
        new.join(self.table(table).select("id"), "id", "left_anti").select(*new.columns).write.mode("append").parquet(self.path(table))

    def _replace_versions(self, table: str, rows: DataFrame, order: str | None = None) -> None:
        """Rows put in place of those of their versions. order: a column by which each task's files are sorted.

        A task writes the files of a few versions side by side, so that whole rows needn't be sorted by version, and one number alone is sorted by its digits.
        """
        if table in schema.TABLES:
            rows = rows.select(*[f"`{n}`" for n in _columns(table)])
        rows = rows if order is None else rows.sortWithinPartitions(order)
        key, conf = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf
        before = conf.get(key)
        conf.set(key, str(WRITERS))
        try:
            self._write_versions(table, rows)
        finally:
            conf.set(key, before)

    def _write_versions(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package_version_id").parquet(self.path(table))

    def index(self, sources: DataFrame, *, min_mass: int = 15, generated_min_mass: int | None = None) -> None:
        """Index sources (see codequarry.sources.files). The first of equal paths of a version wins.

        Versions are pending while their facts are written and complete only afterwards. Sources that can't be
        parsed have a file row and nothing else.
        """
        self.create()
        self._delete("postings_by_term", *VIEWS)  # copies
        keys = ["ecosystem", "name", "version", "path"]
        keyed = first_by(sources, keys, [F.col("ordinal"), F.xxhash64("source")]).select(
            "*", F.xxhash64("ecosystem", "name").alias("package_id"), F.xxhash64("ecosystem", "name", "version").alias("package_version_id"),
            F.xxhash64("ecosystem", "name", "version", "path").alias("file_id"), F.sha2("source", 256).alias("sha256"),
        )
        staged = f"{self.root}/_staged"
        names = [f.split()[0] for f in _KEYS.split(", ")]
        keyed.select(*names, "sha256", "ecosystem", "name", "version", "source_ref").repartition(parts(self.spark), "file_id").write.mode("overwrite").parquet(staged)
        got = self.spark.read.parquet(staged)
        nothing = F.lit(None).cast("map<string,string>")
        versions = got.groupBy("package_version_id", "package_id", "ecosystem", "name", "version").agg(F.max("source_ref").alias("source_ref")).join(checksums(got.select("package_version_id", F.col("sha256").alias("h"))), "package_version_id")
        versions.write.mode("overwrite").parquet(f"{self.root}/_versions")
        versions = self.spark.read.parquet(f"{self.root}/_versions")
        self._append_new("packages", versions.select(F.col("package_id").alias("id"), "ecosystem", "name", nothing.alias("metadata")))
        mine = versions.select(F.col("package_version_id").alias("id"), "package_id", "version", "source_ref", "checksum", F.lit("pending").alias("index_state"), nothing.alias("metadata"))
        self._put_versions(mine)
        # few bytes are read by few tasks: sources are dealt out again, each is parsed once, and its row is stored as it is
        rows = map_arrow(got.select(*names).repartition(parts(self.spark), "file_id"), lambda batches: stage(batches, min_mass, generated_min_mass), PARSED)
        ids = F.zip_with("fragments_line", "fragments_exact_hash", lambda line, h: F.xxhash64(F.sha2(_natural(line, h), 256)))
        self._replace_versions("facts", rows.select("*", ids.alias("ids"), F.transform("terms", lambda x: F.xxhash64(x)).alias("term_ids"), F.sha2("source", 256).alias("sha256")))
        fresh = self.spark.read.schema(STORED).parquet(self.path("facts")).join(F.broadcast(mine.select(F.col("id").alias("package_version_id"))), "package_version_id", "left_semi")
        counted = fresh.select("file_id", "package_id", "package_version_id", "word_counts", F.posexplode("words").alias("pos", "word"))
        self._replace_versions("file_terms", counted.select("file_id", "package_id", "package_version_id", F.xxhash64("word").alias("term_id"), F.col("word_counts")[F.col("pos")].alias("tf")), "term_id")
        self._put_versions(mine.withColumn("index_state", F.lit("complete")))

    def _put_versions(self, rows: DataFrame) -> None:
        """Rows of package_versions put in place of those with their ids, by a staged copy and a swap."""
        names = _columns("package_versions")
        rows = rows.select(*names)
        both = self.table("package_versions").join(rows.select("id"), "id", "left_anti").select(*names).unionByName(rows)
        self._swap("package_versions", both)

    def _swap(self, table: str, rows: DataFrame) -> None:
        to = f"{self.path(table)}_next"
        rows.write.mode("overwrite").parquet(to)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        new, old, back = (jvm.org.apache.hadoop.fs.Path(p) for p in (to, self.path(table), f"{self.path(table)}_last"))
        fs = new.getFileSystem(conf)
        fs.delete(back, True)
        if fs.exists(old):
            fs.rename(old, back)
        if not fs.rename(new, old):
            raise RuntimeError(f"can't put {table} in place")
        fs.delete(back, True)
        self.spark.catalog.refreshByPath(self.path(table))

    def _delete(self, *tables: str) -> None:
        for t in tables:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(t))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def remove_version(self, package_version_id: int) -> None:
        """Deletes a version that isn't complete: its postings, facts, fragments and files, then itself."""
        rows = self.table("package_versions").where(F.col("id") == package_version_id).collect()
        if rows and rows[0]["index_state"] == "complete":
            raise ValueError("a complete version stays")
        self._delete("postings_by_term", *(f"{t}/package_version_id={package_version_id}" for t in ("facts", *schema.BY_VERSION)))
        self._swap("package_versions", self.table("package_versions").where(F.col("id") != package_version_id))

    def cluster_postings(self, partitions: int | None = None) -> None:
        """A second copy of the postings in ranges of terms, which look-ups read until the next change of the index.

        partitions: how many ranges; as many as sources are dealt to, if not said.
        """
        from codequarry.operators.postings import clustered

        self._delete("postings_by_term")
        clustered(self.table("fragment_terms"), partitions or parts(self.spark)).write.mode("overwrite").parquet(self.path("postings_by_term"))

    def compact(self, table: str, files: int = 1) -> None:
        """A table in fewer files, of each version if it has versions; put in place when written. Of facts, which are read from sources' rows, that is a copy that is read until the index changes."""
        if table not in schema.BY_VERSION:
            return self._swap(table, self.table(table).coalesce(files))
        part = next(c for c in ("id", "fragment_id", "file_id") if c in _columns(table))
        if not self._exists(table):
            return self._replace_versions(table, self._view(table, self.spark.read.schema(STORED).parquet(self.path("facts"))).repartition("package_version_id", F.pmod(part, F.lit(files))))
        staged = f"_compacted_{table}"
        rows = self.spark.read.schema(schema.TABLES[table]).parquet(self.path(table))
        rows.write.mode("overwrite").parquet(self.path(staged))
        rows = self.spark.read.schema(schema.TABLES[table]).parquet(self.path(staged))
        self._replace_versions(table, rows.repartition("package_version_id", F.pmod(part, F.lit(files))))
        self._delete(staged)

    def pending(self) -> DataFrame:
        return self.table("package_versions").where("index_state <> 'complete'")

    def resume(self, entries: DataFrame) -> DataFrame:
        """Entries (ecosystem, name, version) without those that are complete."""
        done = self.table("package_versions").where("index_state = 'complete'").select(F.col("id").alias("__cq_done"))
        return entries.join(done, F.xxhash64("ecosystem", "name", "version") == F.col("__cq_done"), "left_anti")


def _natural(line, exact_hash):
    """What a fragment's id is the hash of. A path that is null counts as one called so in Python."""
    return F.concat_ws("|", F.col("package_version_id").cast("string"), F.coalesce(F.col("path"), F.lit("None")), line.cast("string"), exact_hash)


def _columns(table: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in schema.TABLES[table] + ",":
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and not depth:
            out.append(now.split()[0])
            now = ""
        else:
            now += ch
    return out


def publish(spark: SparkSession, report: dict, manifest: dict, to: str, *, most_errors: int = 0) -> None:
    """A report and then a manifest, each renamed from a staged file; the manifest is the commit point."""
    if report.get("error", 0) > most_errors:
        raise ValueError(f"{report['error']} errors; at most {most_errors} may be published")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, value in (("report.json", report), ("manifest.json", manifest)):
        staged, final = (jvm.org.apache.hadoop.fs.Path(f"{to}/{x}") for x in (f".{name}.staged", name))
        fs = final.getFileSystem(conf)
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        fs.delete(final, False)
        fs.rename(staged, final)
