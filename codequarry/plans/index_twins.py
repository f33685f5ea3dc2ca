"""The engine's front over an index of sources made from the part table, so that SQL knows what must come out.

Each part is a file of one of five packages; the sources are those of code_twins. An index is built once a session and folder of
tables, in the shared folder that the session names, and every query asks it for all its rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.index import Index
from codequarry.plans import code_twins
from codequarry.plans.twins import query

ALL = 2**31 - 1
PACKAGES = 5
_BUILT: dict[tuple[str, str], Index] = {}
#: Of those, the ones that have a copy of their postings in ranges of terms.
_RANGED: set[tuple[str, str]] = set()


def _folder(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return "file://" + tempfile.mkdtemp(prefix="codequarry-")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources in the engine's form: path lib/p<key>.ex of package part<key mod 5>, version 1.0.0."""
    key = F.col("path").cast("long")
    return code_twins._sources(spark, d).select(
        F.concat(F.lit("lib/p"), F.col("path"), F.lit(".ex")).alias("path"), "source", F.lit("local").alias("ecosystem"), F.concat(F.lit("part"), F.pmod(key, F.lit(PACKAGES))).alias("name"),
        F.lit("1.0.0").alias("version"), F.lit(None).cast("string").alias("source_ref"), key.alias("ordinal"),
    )


def index(spark: SparkSession, d: str, *, ranged: bool = False) -> Index:
    """ranged: with a copy of the postings in ranges of terms. It costs more than one question gains, so that the others read the postings as they are."""
    known = (spark.sparkContext.applicationId, d)
    if known not in _BUILT:
        _BUILT[known] = Index.build(spark, sources(spark, d), f"{_folder(spark)}/index-{uuid.uuid4().hex}", min_mass=1)
    if ranged and known not in _RANGED:
        _BUILT[known].store.cluster_postings()
        _RANGED.add(known)
    return _BUILT[known]


def _part(path="path"):
    return F.regexp_extract(path, r"p(\d+)\.ex", 1).cast("long").alias("p_partkey")


def _by_file(ix: Index, rows: DataFrame, *columns) -> DataFrame:
    """Rows with a file_id as rows of parts."""
    f = ix.table("files").select(F.col("id").alias("f_id"), F.col("path").alias("f_path"))
    return rows.join(f, F.col("file_id") == F.col("f_id")).select(_part("f_path"), *columns)


_CALL = "CASE p_size % 5 WHEN 0 THEN 'Enum.map(x, 1)' WHEN 1 THEN 'String.trim(x)' WHEN 2 THEN 'x |> Enum.map(2) |> Enum.uniq()' WHEN 3 THEN 'map(x, 1)' ELSE 'list(x, 2)' END"
_SRC = f"""s AS (SELECT p_partkey, p_size, 'part' || p_partkey % {PACKAGES} AS package, 'lib/p' || p_partkey || '.ex' AS path,
 'defmodule Part' || p_partkey || ' do' || chr(10) || '  def run(x) do' || chr(10) || '    ' || {_CALL} || chr(10) || '  end' || chr(10) || chr(10) || '  def other(y, z) do' || chr(10)
 || '    # note ' || p_partkey || chr(10) || '    {{:ok, y, z}}' || chr(10) || '  end' || chr(10) || 'end' || chr(10) AS source FROM part)"""


@query("SELECT p_partkey, 'run' AS name, 1 AS arity FROM part WHERE p_size % 5 IN (0, 2)")
def index_structural(spark, d):
    """A structural query of a stored index, by postings and matcher."""
    ix = index(spark, d, ranged=True)
    rows = ix.all("from(f in Fragment, where: matches(f, def _ do ... end), where: contains(f, Enum.map(_, _)))", limit=ALL).select("f.*")
    return _by_file(ix, rows, "name", "arity")


@query(f"SELECT p_partkey, 'other' AS name FROM part WHERE p_partkey % {PACKAGES} = 3")
def index_scoped(spark, d):
    """The same, of one package only."""
    ix = index(spark, d)
    rows = ix.all("from(f in Fragment, where: matches(f, def other(_, _) do ... end))", limit=ALL, **ix.scope_ids(package=("local", "part3"))).select("f.*")
    return _by_file(ix, rows, "name")


@query("SELECT p_partkey FROM part")
def index_code_or_text(spark, d):
    """Fragments whose comments hold a text."""
    ix = index(spark, d)
    rows = ix.all('from(f in Fragment, where: matches(f, def _ do ... end), where: contains(f, "note"))', limit=ALL).select("f.*")
    return _by_file(ix, rows)


@query("SELECT p_partkey, 'run' AS name, 'Enum.map/2' AS called FROM part WHERE p_size % 5 IN (0, 2)")
def index_join(spark, d):
    """Fragments and the references that lie in them."""
    ix = index(spark, d)
    q = 'from(f in Fragment, join: r in assoc(f, :references), where: f.kind == :def, where: r.qualified_name == "Enum.map/2", select: {f, r})'
    rows = ix.all(q, limit=ALL).select("f.file_id", "f.name", F.col("r.qualified_name").alias("called"))
    return _by_file(ix, rows, "name", "called")


@query("SELECT p_partkey, 'run' AS name FROM part WHERE p_size % 5 IN (0, 2) ORDER BY p_partkey")
def index_definition_calls(spark, d):
    """Definitions and the calls that are made in them."""
    ix = index(spark, d)
    q = 'from(d in Definition, join: c in assoc(d, :calls), where: c.callee_qualified_name == "Enum.map/2", select: {d, c})'
    return _by_file(ix, ix.all(q, limit=ALL).select("d.file_id", "d.name"), "name")


@query(f"SELECT 'part' || k AS name, '1.0.0' AS version FROM range({PACKAGES}) t(k)")
def index_entities(spark, d):
    """packages' versions as a query's source."""
    ix = index(spark, d)
    rows = ix.all('from(v in PackageVersion, where: v.version == "1.0.0")', limit=ALL).select("v.*")
    return rows.join(ix.table("packages").select(F.col("id").alias("p_id"), "name"), F.col("package_id") == F.col("p_id")).select("name", "version")


@query("SELECT count(*) AS n FROM part WHERE p_size % 5 IN (0, 2)")
def index_count(spark, d):
    """A3: an exact structural count."""
    return spark.createDataFrame([(index(spark, d).count("from(f in Fragment, where: matches(f, def _ do ... end), where: contains(f, Enum.map(_, _)))"),)], "n long")


@query("SELECT least(count(*), 10000) AS value, CASE WHEN count(*) > 10000 THEN 'gte' ELSE 'eq' END AS relation FROM part WHERE p_size % 5 = 2")
def index_estimate(spark, d):
    """A4, A10: candidates before the matcher, at most 10,000."""
    e = index(spark, d).estimate("from(f in Fragment, where: matches(f, def run(_) do ... end), where: contains(f, Enum.uniq(_)))")
    return spark.createDataFrame([(e.value, e.relation)], "value long, relation string")


@query("""SELECT p_partkey, 3 AS line, 5 AS "column", 'module' AS kind, 'Part' || p_partkey AS name FROM part WHERE p_size % 5 = 0""")
def index_text(spark, d):
    """A literal's places, with the first fragment of each file."""
    return index(spark, d).search_text("Enum.map(x", limit=ALL, mode="first").select(_part(), "line", "column", "kind", "name")


@query("""SELECT p_partkey, 7 AS line, 7 AS "column" FROM part WHERE p_partkey % 10 < 5""")
def index_regex(spark, d):
    """A regular expression's places."""
    return index(spark, d).search_regex(r"note \d*[0-4]\n", limit=ALL).select(_part(), "line", "column")


@query(f"""WITH {_SRC}, w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(source), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM s),
l AS (SELECT p_partkey, len(w)::DOUBLE AS n FROM w), t AS (SELECT p_partkey, x AS term, count(*) AS tf FROM (SELECT p_partkey, unnest(w) AS x FROM w) WHERE x IN ('uniq', 'map') GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT p_partkey, round(sum(ln(1 + ((SELECT count(*) FROM l) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(n) FROM l)))), 6) AS score
FROM t JOIN f USING (term) JOIN l USING (p_partkey) GROUP BY p_partkey""")
def index_ranked(spark, d):
    """Files by BM25 from the stored postings of words."""
    return index(spark, d).search_ranked("uniq map", limit=ALL).select(_part(), F.round("score", 6).alias("score"))


@query("""SELECT p_partkey, '# note ' || p_partkey AS text, 7 AS line FROM part""")
def index_comments(spark, d):
    """Comments that hold a literal."""
    return index(spark, d).search_comments("note", limit=ALL).select(_part(), "text", "line")


@query("""SELECT p_partkey, 'Part' || p_partkey || '.run/1' AS qualified_name, 2 AS line FROM part""")
def index_definitions(spark, d):
    """Definitions by a part of their name."""
    return index(spark, d).search_definitions(".RUN/", limit=ALL).select(_part(), "qualified_name", "line")


@query("""SELECT p_partkey, 'Enum.uniq/1' AS qualified_name, 3 AS line FROM part WHERE p_size % 5 = 2""")
def index_references(spark, d):
    """References by a part of their name."""
    return index(spark, d).search_references("enum.uniq", limit=ALL).select(_part(), "qualified_name", "line")


@query("""SELECT p_partkey, 'Part' || p_partkey || '.run/1' AS caller FROM part WHERE p_size % 5 = 4""")
def index_callers(spark, d):
    """Who calls a function."""
    ix = index(spark, d)
    return _by_file(ix, ix.search_callers(".list/2", limit=ALL), F.col("caller_qualified_name").alias("caller"))


@query("""SELECT p_partkey, unnest(CASE p_size % 5 WHEN 0 THEN ['Enum.map/2'] WHEN 1 THEN ['String.trim/1'] WHEN 2 THEN ['Enum.map/2', 'Enum.uniq/1'] WHEN 3 THEN ['Part' || p_partkey || '.map/2'] ELSE ['Part' || p_partkey || '.list/2'] END) AS callee FROM part""")
def index_callees(spark, d):
    """What a function calls."""
    ix = index(spark, d)
    return _by_file(ix, ix.search_callees(".run/1", limit=ALL), F.col("callee_qualified_name").alias("callee"))


@query("SELECT p_partkey, 'other' AS name, 1.0::DOUBLE AS similarity FROM part")
def index_similar(spark, d):
    """Functions like another, by sub-trees and then by tree edits."""
    ix = index(spark, d)
    rows = ix.similar("def other(first, second) do\n  {:ok, first, second}\nend", min_similarity=0.99, limit=ALL)
    return _by_file(ix, rows, "name", "similarity")


@query("SELECT p_partkey, 'other' AS name, 1.0::DOUBLE AS similarity FROM part")
def index_similar_scan(spark, d):
    """X11: the same without a prefilter."""
    ix = index(spark, d)
    rows = ix.similar("def other(first, second) do\n  {:ok, first, second}\nend", min_similarity=0.99, limit=ALL, prefilter="scan")
    return _by_file(ix, rows, "name", "similarity")


_AUDIT = """SELECT p_partkey, 'maps' AS "check", 'Enum.map(_, _)' AS message, 3 AS line FROM part WHERE p_size % 5 IN (0, 2)
UNION ALL SELECT p_partkey, 'trims', 'String.trim(_)', 3 FROM part WHERE p_size % 5 = 1"""


@query(_AUDIT)
def index_audit(spark, d):
    """Findings of several patterns at once."""
    found = index(spark, d).audit({"maps": ["Enum.map(_, _)"], "trims": ["String.trim(_)"]})
    return found.select(_part("file"), "check", "message", "line")


@query(_AUDIT)
def index_audit_anchor(spark, d):
    """The same by each pattern's rarest term."""
    found = index(spark, d).audit({"maps": ["Enum.map(_, _)"], "trims": ["String.trim(_)"]}, mode="anchor", most_df=10**9)
    return found.select(_part("file"), "check", "message", "line")


@query("SELECT 'def' AS kind, 2 * count(*) AS n, count(*) AS files FROM part UNION ALL SELECT 'module', count(*), count(*) FROM part")
def index_kinds(spark, d):
    """Fragments and files by kind."""
    return index(spark, d).kinds().where("kind IN ('def', 'module')")


@query(f"SELECT 'part' || k AS name, count(p_partkey) AS n FROM range({PACKAGES}) t(k) LEFT JOIN part ON p_partkey % {PACKAGES} = k GROUP BY k")
def index_files_by_package(spark, d):
    """Files of each package, by left joins of dimensions."""
    ix = index(spark, d)
    n = ix.table("files").groupBy("package_id").agg(F.count("*").alias("n"))
    return ix.package_counts().select("id", "name").join(n, F.col("id") == F.col("package_id"), "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT 'files' AS name, count(*) AS n FROM part UNION ALL SELECT 'definitions', 3 * count(*) FROM part UNION ALL SELECT 'comments', count(*) FROM part UNION ALL SELECT 'packages', least(count(*), 5) FROM part")
def index_stats(spark, d):
    """Rows of the stored tables."""
    stats = index(spark, d).stats()
    return spark.createDataFrame([(k, stats[k]) for k in ("files", "definitions", "comments", "packages")], "name string, n long")


@query("SELECT 'lib/p' || p_partkey || '.ex' AS value, 1::BIGINT AS n FROM part WHERE starts_with('lib/p' || p_partkey || '.ex', 'lib/p1')")
def index_complete(spark, d):
    """Completions of a path."""
    return index(spark, d).complete("path", "lib/p1", limit=ALL)


@query(f"""WITH {_SRC} SELECT path, sha256(source) AS sha256, (SELECT sha256(string_agg(path || ':' || sha256(source), chr(10) ORDER BY path)) FROM s WHERE package = 'part1') AS fingerprint FROM s WHERE package = 'part1'""")
def index_hydrate(spark, d):
    """A version's files, whole, and their fingerprint."""
    got = index(spark, d).hydrate("local", "part1", "1.0.0", max_files=1_000_000, max_bytes=1 << 30)
    return spark.createDataFrame([(f["path"], f["sha256"], got.fingerprint) for f in got.files], "path string, sha256 string, fingerprint string")


@query(f"WITH {_SRC} SELECT path, source FROM s WHERE p_partkey = 7")
def index_file_source(spark, d):
    """One file's source."""
    found = index(spark, d).file_source("local", "part2", "1.0.0", "lib/p7.ex")
    return spark.createDataFrame([("lib/p7.ex", found)] if found is not None else [], "path string, source string")


@query("SELECT 7 AS p_partkey, 'Part7' AS name, 1 AS line FROM part WHERE p_partkey = 7")
def index_get(spark, d):
    """A fragment by its id."""
    ix = index(spark, d)
    known = ix.table("fragments").where("kind = 'module' AND name = 'Part7'").select("id").limit(1).collect()
    return ix.get(known[0]["id"] if known else 0).select(F.lit(7).alias("p_partkey"), "name", "line")


@query("SELECT 'call' AS kind, '{}' AS label FROM part WHERE p_partkey = 7 UNION ALL SELECT 'literal', 'ok' FROM part WHERE p_partkey = 7 UNION ALL SELECT 'variable', 'y' FROM part WHERE p_partkey = 7 UNION ALL SELECT 'variable', 'z' FROM part WHERE p_partkey = 7")
def index_tree_nodes(spark, d):
    """The nodes of a fragment's tree."""
    ix = index(spark, d)
    f = ix.table("files").where("path = 'lib/p7.ex'").select(F.col("id").alias("f_id"))
    known = ix.table("fragments").join(f, F.col("file_id") == F.col("f_id")).where("line = 8 AND kind = 'expression'").select("id").limit(1).collect()
    return ix.tree_nodes(known[0]["id"] if known else 0).select("kind", "label")


@query(f"SELECT 'part' || k AS name, 'complete' AS state FROM range({PACKAGES}) t(k)")
def index_completion(spark, d):
    """K8: the state of each version."""
    ix = index(spark, d)
    v = ix.table("package_versions").join(ix.table("packages").select(F.col("id").alias("p_id"), "name"), F.col("package_id") == F.col("p_id"))
    return v.select("name", F.col("index_state").alias("state"))


@query("SELECT 'new' AS name, '1.0.0' AS version UNION ALL SELECT 'part1', '2.0.0'")
def index_resume(spark, d):
    """Entries that aren't complete."""
    entries = spark.createDataFrame([("local", "part1", "1.0.0"), ("local", "part1", "2.0.0"), ("local", "new", "1.0.0")], "ecosystem string, name string, version string")
    return index(spark, d).store.resume(entries).select("name", "version")


@query("SELECT p_partkey, 'String.trim/1' AS term FROM part WHERE p_size % 5 = 1")
def index_postings(spark, d):
    """K3, K4, K9: stored postings of a term over all versions, read from their copy in ranges of terms."""
    ix = index(spark, d, ranged=True)
    hit = ix.table("fragment_terms").where(F.col("term_id") == F.xxhash64(F.lit("call.remote:String.trim/1"))).select("fragment_id")
    rows = ix.table("fragments").where("kind = 'module'").join(hit, F.col("id") == F.col("fragment_id"), "left_semi")
    return _by_file(ix, rows, F.lit("String.trim/1").alias("term"))


@query("SELECT p_partkey, 'run' AS name FROM part WHERE p_partkey <> 1 UNION ALL SELECT 1, 'again' FROM part WHERE p_partkey = 1")
def index_replaced(spark, d):
    """One package indexed again with a changed file; its rows are replaced, the others' stay."""
    root = f"{_folder(spark)}/index-{uuid.uuid4().hex}"
    ix = Index.build(spark, sources(spark, d), root, min_mass=1)
    mine = sources(spark, d).where("name = 'part1'")
    ix.store.index(mine.withColumn("source", F.when(F.col("path") == "lib/p1.ex", F.replace("source", F.lit("def run("), F.lit("def again("))).otherwise(F.col("source"))), min_mass=1)
    return _by_file(ix, ix.table("definitions").where("kind = 'def' AND name <> 'other'"), "name")


@query("SELECT p_partkey, 'other' AS name FROM part")
def index_compacted(spark, d):
    """A table of versions in fewer files has the same rows."""
    ix = index(spark, d)
    ix.store.compact("definitions", 1)
    return _by_file(ix, ix.table("definitions").where("name = 'other'"), "name")


@query("SELECT p_partkey, path, line FROM (SELECT p_partkey, 'lib/p' || p_partkey || '.ex' AS path, 7 AS line FROM part) WHERE line IS NOT NULL")
def index_files_fetched(spark, d):
    """Comment rows of files by a scan of one table."""
    ix = index(spark, d)
    rows = ix.table("comments").select("file_id", "line")
    return _by_file(ix, rows, F.col("f_path").alias("path"), "line")
