"""From a Plan to a DataFrame: scan, joins, filters, order; the matcher last."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry import schema
from codequarry.functions import match
from codequarry.functions import text as T
from codequarry.functions.elixir import decode
from codequarry.operators import postings
from codequarry.operators.joins import within
from codequarry.plans.model import Plan, Predicate, QueryError
from codequarry.ship import map_arrow

Tables = Callable[[str], DataFrame]
DEF_KINDS = ("def", "defp", "defmacro", "defmacrop")


def condition(p: Predicate, c: Column) -> Column:
    if p.op == "eq":
        return c == F.lit(p.value)
    if p.op == "in":
        return c.isin(*p.value) if p.value else F.lit(False)
    if p.op == "prefix_search":
        return T.prefix_ilike(c, p.value)
    return {">": c > p.value, "<": c < p.value, ">=": c >= p.value, "<=": c <= p.value}[p.comparison]


def scope(df: DataFrame, package_id: int | None = None, package_version_id: int | None = None, entity: str | None = None) -> DataFrame:
    """Rows of one package or version; packages and versions are scoped by their own keys."""
    keys = {"package": ("id", None), "package_version": ("package_id", "id")}.get(entity or "", ("package_id", "package_version_id"))
    if package_id is not None:
        df = df.where(F.col(keys[0]) == package_id)
    if package_version_id is not None and keys[1]:
        df = df.where(F.col(keys[1]) == package_version_id)
    return df


def with_terms(fragments: DataFrame, tables: Tables, wanted: list[str], id_: str = "id") -> DataFrame:
    """Fragments with all wanted terms. Term ids are hashes, so no look-up comes first; a term nobody has leaves nothing."""
    if not wanted:
        return fragments
    spark = fragments.sparkSession
    ids = [r[0] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(F.xxhash64("t")).collect()]  # as many as the query names
    hit = postings.intersect(tables("fragment_terms"), "fragment_id", ids, "term_id")
    return fragments.join(hit.withColumnRenamed("fragment_id", "__cq_hit"), F.col(id_) == F.col("__cq_hit"), "left_semi")


def verified(df: DataFrame, structural: list[Predicate], ast: str = "ast") -> DataFrame:
    """Rows whose tree passes every structural predicate; the one place where Python sees rows."""
    trees = [(p.op, p.value) for p in structural if not isinstance(p.value, str)]
    if not trees:
        return df

    def run(batches):
        rules = [(op, match.compiled(v)) for op, v in trees]
        for b in batches:
            keep = []
            for i, text in enumerate(b.column(ast).to_pylist()):
                tree = match.compiled(decode(json.loads(text)))
                if all(match.match(r, tree) is not None if op == "matches" else match.strictly_within(r, tree) for op, r in rules):
                    keep.append(i)
            yield b.take(keep)

    return map_arrow(df, run, df.schema)


def _prefixed(df: DataFrame, binding: str, fields) -> DataFrame:
    return df.select(*[F.col(f).alias(f"{binding}__{f}") for f in fields])


def compile_plan(plan: Plan, tables: Tables, *, package_id: int | None = None, package_version_id: int | None = None) -> DataFrame:
    """Rows with one struct a binding of the whole query, before order and page; plus the order's columns."""
    q = plan.query
    text = [p.value for p in plan.structural if isinstance(p.value, str)]
    base = scope(tables(schema.TABLE_OF[q.source]), package_id, package_version_id, q.source)
    for p in plan.scan:
        if p.binding == q.binding:
            base = base.where(condition(p, F.col(p.field)))
    if q.source == "fragment":
        if plan.kind:
            base = base.where(F.col("kind") == plan.kind)
            if plan.name:
                base = base.where(F.col("name") == plan.name)
            if plan.arity is not None:
                base = base.where(F.col("arity") == plan.arity)
        base = with_terms(base, tables, plan.required_terms)
        if q.joins:
            base = base.where(F.col("kind").isin(*DEF_KINDS))
    needs_ast = any(not isinstance(p.value, str) for p in plan.structural)
    out = _prefixed(base, q.binding, [*schema.FIELDS[q.source], *(["ast"] if needs_ast else []), *(["last_line"] if text else [])])
    b = q.binding
    for j in q.joins:
        target = schema.ASSOCIATIONS[q.source][j.association]
        fact = tables(schema.TABLE_OF[target])
        for p in plan.scan:
            if p.binding == j.binding:
                fact = fact.where(condition(p, F.col(p.field)))
        fact = _prefixed(fact, j.binding, schema.FIELDS[target])
        if q.source == "definition":
            on = (F.col(f"{j.binding}__caller_qualified_name") == F.col(f"{b}__qualified_name")) & (F.col(f"{j.binding}__package_version_id") == F.col(f"{b}__package_version_id"))
        else:
            on = (F.col(f"{j.binding}__file_id") == F.col(f"{b}__file_id")) & within(F.col(f"{j.binding}__line"), F.col(f"{b}__line"), F.col(f"{b}__end_line"))
        out = out.join(fact, on)
    named = {j.association: j.binding for j in q.joins}
    if {"definitions", "calls"} <= set(named):
        out = out.where(F.col(f"{named['calls']}__caller_qualified_name") == F.col(f"{named['definitions']}__qualified_name"))
    if q.joins and q.source == "fragment":  # one row a fragment, the first by its facts' places
        order = [x for j in q.joins for x in (F.col(f"{j.binding}__line").asc_nulls_last(), F.col(f"{j.binding}__id"))]
        out = out.withColumn("__cq_rn", F.row_number().over(Window.partitionBy(f"{b}__id").orderBy(*order))).where("__cq_rn = 1").drop("__cq_rn")
    for t in text:
        files = tables("files").where(F.col("source").contains(t)).select(F.col("id").alias("__cq_file"), "source")
        slice_ = T.line_slice(F.col("source"), F.col(f"{b}__line"), F.least(F.coalesce(F.col(f"{b}__end_line"), F.col(f"{b}__last_line")), F.greatest(F.col(f"{b}__last_line"), F.col(f"{b}__line"))))
        out = out.join(files, F.col(f"{b}__file_id") == F.col("__cq_file")).where(slice_.contains(t)).drop("__cq_file", "source")
    return verified(out, plan.structural, f"{b}__ast")


def order_of(plan: Plan) -> list[str]:
    b = plan.query.binding
    return {
        "fragment": [f"{b}__mass", f"{b}__id"],
        "definition": [f"{b}__qualified_name", f"{b}__line", f"{b}__id"],
        "reference": [f"{b}__qualified_name", f"{b}__line", f"{b}__id"],
        "call_edge": [f"{b}__caller_qualified_name", f"{b}__callee_qualified_name", f"{b}__id"],
        "package": [f"{b}__ecosystem", f"{b}__name", f"{b}__id"],
        "package_version": [f"{b}__version", f"{b}__id"],
        "file": [f"{b}__path", f"{b}__id"],
    }[plan.query.source]


def selected(df: DataFrame, plan: Plan) -> DataFrame:
    """The selected bindings, as structs under their names."""
    q = plan.query
    wanted = [q.binding] if q.select is None else [q.select] if isinstance(q.select, str) else q.select
    structs = []
    for name in wanted:
        fields = schema.FIELDS[q.source_of(name)]
        structs.append(F.struct(*[F.col(f"{name}__{f}").alias(f) for f in fields]).alias(name))
    if not structs:
        raise QueryError("nothing is selected")
    return df.select(*structs)
