"""The versioned query object, its JSON form, and the checks on it."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from codequarry import schema

VERSION = 1
COMPARISONS = (">", "<", ">=", "<=")


class QueryError(ValueError):
    pass


@dataclass
class Predicate:
    """op: eq, cmp, in, prefix_search, matches or contains."""

    op: str
    binding: str
    value: Any
    field: str | None = None
    comparison: str | None = None


@dataclass
class Join:
    parent: str
    binding: str
    association: str


@dataclass
class Query:
    source: str
    binding: str
    predicates: list[Predicate] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    select: str | list[str] | None = None
    limit: int | None = None
    version: int = VERSION

    def to_map(self) -> dict:
        return asdict(self)

    @classmethod
    def from_map(cls, m: dict) -> Query:
        if m.get("version", VERSION) != VERSION:
            raise QueryError(f"unsupported query version: {m.get('version')!r}")
        try:
            return cls(m["source"], m["binding"], [Predicate(**p) for p in m.get("predicates", [])], [Join(**j) for j in m.get("joins", [])], m.get("select"), m.get("limit"))
        except (KeyError, TypeError) as e:
            raise QueryError(f"malformed query: {e}") from None

    def source_of(self, binding: str) -> str:
        if binding == self.binding:
            return self.source
        for j in self.joins:
            if j.binding == binding:
                return schema.ASSOCIATIONS[self.source][j.association]
        raise QueryError(f"unbound {binding!r}")


@dataclass
class Estimate:
    value: int | None
    relation: str


@dataclass
class Plan:
    """A checked query: what the scan can do by itself, what the matcher must, and what comes out."""

    query: Query
    scan: list[Predicate]
    structural: list[Predicate]
    required_terms: list[str]
    kind: str | None
    name: str | None
    arity: int | None
    execution: str
    hydration: str


def capabilities() -> dict:
    return {
        "version": VERSION, "api_version": 1, "error_version": 1, "endpoints": ["query", "plan", "hydrate", "capabilities"],
        "sources": list(schema.FIELDS), "predicates": ["matches", "contains", "prefix_search", "eq", "cmp", "in"],
        "associations": {s: list(a) for s, a in schema.ASSOCIATIONS.items()}, "hydration": ["package_version"],
    }


def validate(q: Query) -> Query:
    """Raises QueryError for the first of eight kinds of mistake."""
    if q.version != VERSION:
        raise QueryError(f"unsupported query version: {q.version!r}")
    if q.source not in schema.FIELDS:
        raise QueryError(f"unsupported source: {q.source!r}")
    most = schema.MOST_JOINS.get(q.source, 0)
    if len(q.joins) > most:
        raise QueryError(f"{q.source} queries take at most {most} joins")
    for j in q.joins:
        if j.parent != q.binding:
            raise QueryError(f"joins must start from {q.binding!r}, not {j.parent!r}")
        if j.association not in schema.ASSOCIATIONS[q.source]:
            raise QueryError(f"{q.source} has no association {j.association!r}")
    for what, names in (("association", [j.association for j in q.joins]), ("binding", [q.binding, *(j.binding for j in q.joins)])):
        if len(set(names)) != len(names):
            raise QueryError(f"an {what} occurs twice: {names}")
    for p in q.predicates:
        source = q.source_of(p.binding)
        if p.op in ("matches", "contains"):
            if p.binding != q.binding or q.source != "fragment":
                raise QueryError(f"{p.op} needs the fragment source")
            continue
        if p.op not in ("eq", "cmp", "in", "prefix_search"):
            raise QueryError(f"unsupported predicate: {p.op!r}")
        if p.field not in schema.FIELDS[source]:
            raise QueryError(f"{source} has no field {p.field!r}")
        if p.op == "eq" and p.value is None:
            raise QueryError("a field can't be compared with nil")
        if p.op == "cmp" and p.comparison not in COMPARISONS:
            raise QueryError(f"unsupported comparison: {p.comparison!r}")
    for b in [q.select] if isinstance(q.select, str) else q.select or []:
        q.source_of(b)
    if q.limit is not None and (not isinstance(q.limit, int) or q.limit < 1):
        raise QueryError("a limit must be a positive number")
    return q
