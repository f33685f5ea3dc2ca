"""The engine's own operators over sources that are made from the part table, so that SQL knows what must come out.

Each part is a file of one module with two functions, a comment and a call that depends on its size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import match
from codequarry.operators import extract
from codequarry.plans.compiler import verified
from codequarry.plans.model import Predicate
from codequarry.plans.twins import query, read

#: Bodies by the part's size: remote calls, a pipe, and local calls whose names types have too.
_CALLS = ("Enum.map(x, 1)", "String.trim(x)", "x |> Enum.map(2) |> Enum.uniq()", "map(x, 1)", "list(x, 2)")


def _sources(spark, d):
    p = read(spark, d, "part")
    call = F.element_at(F.array(*[F.lit(c) for c in _CALLS]), (F.col("p_size") % 5 + 1).cast("int"))
    head = F.concat(F.lit("defmodule Part"), F.col("p_partkey"), F.lit(" do\n  def run(x) do\n    "))
    tail = F.concat(F.lit("\n  end\n\n  def other(y, z) do\n    # note "), F.col("p_partkey"), F.lit("\n    {:ok, y, z}\n  end\nend\n"))
    return p.select(F.col("p_partkey").cast("string").alias("path"), F.concat(head, call, tail).alias("source"))


def _rows(spark, d, kind, fields, kinds=None):
    found = extract.rows(_sources(spark, d), kind, fields, min_mass=1, kinds=kinds)
    return found.withColumn("p_partkey", F.col("path").cast("long"))


def _matching(spark, d, predicates):
    """Function fragments that pass predicates: kind and required terms first, the matcher last."""
    rows = _rows(spark, d, "fragments", ["name", "terms", "ast"], kinds=("def",))
    for p in predicates:
        for t in sorted(match.required_terms(match.compiled(p.value))):
            rows = rows.where(F.array_contains("terms", t))
    return verified(rows.select("p_partkey", "name", "ast"), predicates)


@query("""SELECT p_partkey, kind, name, arity, line, end_line FROM (
SELECT p_partkey, 'module' AS kind, 'Part' || p_partkey AS name, NULL::INTEGER AS arity, 1 AS line, NULL::INTEGER AS end_line FROM part
UNION ALL SELECT p_partkey, 'def', 'run', 1, 2, 5 FROM part UNION ALL SELECT p_partkey, 'def', 'other', 2, 6, 999999 FROM part)""")
def fragment_extract(spark, d):
    """Modules and functions of each source, with their lines."""
    return _rows(spark, d, "fragments", ["kind", "name", "arity", "line", "end_line"], kinds=("module", "def")).select("p_partkey", "kind", "name", "arity", "line", "end_line")


@query("SELECT p_partkey, 'run' AS name FROM part WHERE p_size % 5 IN (0, 2)")
def structural_contains(spark, d):
    """Functions with a call within; a pipe is a call."""
    p = [Predicate("matches", "f", "def _ do ... end"), Predicate("contains", "f", "Enum.map(_, _)")]
    return _matching(spark, d, [Predicate(x.op, x.binding, match.compiled(x.value)) for x in p]).select("p_partkey", "name")


@query("SELECT p_partkey, 'other' AS name FROM part")
def structural_matches(spark, d):
    """Functions by the shape of their head."""
    return _matching(spark, d, [Predicate("matches", "f", match.compiled("def other(_, _) do ... end"))]).select("p_partkey", "name")


@query("""SELECT p_partkey, unnest(CASE p_size % 5 WHEN 0 THEN ['Enum.map/2'] WHEN 1 THEN ['String.trim/1'] WHEN 2 THEN ['Enum.map/2', 'Enum.uniq/1'] WHEN 3 THEN ['map/2'] ELSE ['list/2'] END) AS qualified_name, 3 AS line FROM part""")
def reference_extract(spark, d):
    """Calls of other modules' functions and of a module's own, also of such as are named like types."""
    return _rows(spark, d, "references", ["qualified_name", "line"], kinds=("remote_call", "local_call")).select("p_partkey", "qualified_name", "line")


@query("""SELECT p_partkey, unnest(['Part' || p_partkey || '.run/1', 'Part' || p_partkey || '.other/2']) AS qualified_name, unnest([2, 6]) AS line FROM part""")
def definition_extract(spark, d):
    """Functions that are defined."""
    return _rows(spark, d, "definitions", ["qualified_name", "line"], kinds=("def",)).select("p_partkey", "qualified_name", "line")


@query("""SELECT p_partkey, '# note ' || p_partkey AS text, 7 AS line, 5 AS "column" FROM part""")
def comment_extract(spark, d):
    """E5: comments with their places."""
    return _rows(spark, d, "comments", ["text", "line", "column"]).select("p_partkey", "text", "line", "column")


@query("""SELECT p_partkey, 'Part' || p_partkey || '.run/1' AS caller, unnest(CASE p_size % 5 WHEN 0 THEN ['Enum.map/2'] WHEN 1 THEN ['String.trim/1'] WHEN 2 THEN ['Enum.map/2', 'Enum.uniq/1'] WHEN 3 THEN ['Part' || p_partkey || '.map/2'] ELSE ['Part' || p_partkey || '.list/2'] END) AS callee FROM part""")
def call_graph_extract(spark, d):
    """Callers and callees."""
    return _rows(spark, d, "edges", ["caller", "callee"]).select("p_partkey", "caller", "callee")
