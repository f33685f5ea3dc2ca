"""From a checked query to a Plan: which predicates the scan can take, and what the patterns imply."""

from __future__ import annotations

from codequarry.functions import match
from codequarry.plans.model import Plan, Predicate, Query, validate

#: Terms that nearly every fragment has; they would only cost a look-up.
BROAD = ("def.visibility:", "node:def", "node:def_like", "atom:do", "node:{}", "node:call")


def pattern_of(p: Predicate):
    return match.compiled(p.value)


def plan(q: Query) -> Plan:
    validate(q)
    structural = [p for p in q.predicates if p.op in ("matches", "contains")]
    scan = [p for p in q.predicates if p not in structural]
    terms: set[str] = set()
    kind = name = arity = None
    for p in structural:
        if isinstance(p.value, str):
            continue  # text
        tree = pattern_of(p)
        terms |= {t for t in match.required_terms(tree) if not t.startswith(BROAD)}
        if p.op == "matches" and kind is None:
            kind, name, arity = match.pushdown(tree)
    execution = "entity" if q.source in ("package", "package_version", "file") else "joined" if q.joins else "structural" if structural else "filtered"
    # kind and name in the scan do what postings would, without a join
    if kind and name:
        terms = {t for t in terms if not t.startswith(("def.name:", f"call.local:{name}/", f"node:{name}"))}
    return Plan(q, scan, structural, sorted(terms), kind, name, arity, execution, "late" if structural else "none")
