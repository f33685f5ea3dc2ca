"""What a server in front of an index calls: requests and answers are plain dicts, pages are bounded.

Errors come back as {"version": 1, "error": {"code", "message", "details"}} beside their HTTP status.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from codequarry import schema
from codequarry.functions.elixir import ParseError
from codequarry.index import Index, LimitError
from codequarry.operators.paging import decode_cursor, encode_cursor
from codequarry.plans import model
from codequarry.plans.model import Query, QueryError

MOST_ROWS, DEFAULT_ROWS, DSL_ROWS = 200, 50, 100
_SHORT = re.compile(r"\s*(matches|contains)\(", re.S)
#: Marks of a pattern: a query, a hole, a rest of arguments, or a definition.
_MARKS = re.compile(r"from[( ]|defp? |fn |.*(?:_|\.\.\.)", re.S)


class RequestError(ValueError):
    def __init__(self, status: int, code: str, message: str, **details):
        super().__init__(message)
        self.status, self.code, self.details = status, code, details

    def body(self) -> dict:
        return {"version": 1, "error": {"code": self.code, "message": str(self), "details": self.details}}


def search_mode(mode: str | None, pattern: str) -> str:
    """The mode asked for; by default structural if the pattern has a mark of one, else text."""
    if mode and mode != "auto":
        return mode
    return "structural" if _MARKS.match(pattern.strip()) else "text"


def page_size(value: Any, default: int = DEFAULT_ROWS) -> int:
    """1 to MOST_ROWS; what is no number is the default."""
    try:
        return min(max(int(value), 1), MOST_ROWS)
    except (TypeError, ValueError):
        return default


def _plain(value: Any) -> Any:
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items() if k not in ("ast", "sub_hashes", "terms", "exact_hash", "content_hash")}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _answer(rows: DataFrame, began: float) -> tuple[list[dict], dict]:
    found = [_plain(r) for r in rows.collect()]  # a page
    return found, {"results": found, "count": len(found), "elapsed_ms": round(1000 * (time.monotonic() - began), 1)}


def _guard(code: str):
    """Turns what a bad request raises into a RequestError of the given code."""

    def outer(function: Callable):
        def inner(index: Index, params: dict) -> dict:
            try:
                return function(index, params)
            except RequestError:
                raise
            except LimitError as e:
                raise RequestError(413, "snapshot_limit_exceeded", str(e), dimension=e.what, actual=e.actual, limit=e.limit) from None
            except (QueryError, ParseError, PySparkException, re.error, ValueError, TypeError, KeyError) as e:
                raise RequestError(400, code, str(e).split("\n")[0][:500]) from None

        inner.__doc__ = function.__doc__
        return inner

    return outer


def _scope(params: dict) -> dict:
    return {"package_id": int(params["package_id"])} if params.get("package_id") is not None else {}


@_guard("invalid_search")
def search(index: Index, params: dict) -> dict:
    """pattern, mode, limit, cursor, package_id: a page of text, regex or structural hits, or of a query's rows."""
    began, pattern = time.monotonic(), params.get("pattern") or ""
    mode, limit, scope = search_mode(params.get("mode"), pattern), page_size(params.get("limit")), _scope(params)
    if mode == "structural" and (_SHORT.match(pattern) or pattern.strip().startswith(("from(", "from "))):
        return query(index, {"query": pattern, "cursor": params.get("cursor"), "limit": limit, **scope})
    if mode == "structural":
        at = decode_cursor(params.get("cursor"))
        found, out = _answer(index.search(pattern, limit=limit, cursor=at if len(at) == 3 else None, **scope), began)
        last = [found[-1][k] for k in ("mass", "id", "match")] if len(found) == limit else None
    else:
        skip = next(iter(decode_cursor(params.get("cursor"))), 0)
        skip = skip if isinstance(skip, int) and skip > 0 else 0
        ask = index.search_regex if mode == "regex" else index.search_text
        found, out = _answer(ask(pattern, skip=skip, limit=limit, **scope), began)
        last = [skip + limit] if len(found) == limit else None
    return out | {"mode": mode, "next_cursor": encode_cursor(*last) if last else None}


@_guard("invalid_query")
def query(index: Index, params: dict) -> dict:
    """query (a string or a versioned object), limit, cursor: a page of its rows. The query's own limit comes first."""
    began, asked = time.monotonic(), params.get("query")
    if not isinstance(asked, str | dict) or not asked:
        raise QueryError("query must be a string or an object")
    q = index.query(asked)
    limit = page_size(q.limit or params.get("limit"), DSL_ROWS)
    at = decode_cursor(params.get("cursor"))
    keyed = q.source == "fragment"
    skip = at[0] if not keyed and len(at) == 1 and isinstance(at[0], int) and at[0] > 0 else 0
    # two more columns than the selection are needed for the cursor
    rows = index.all(Query(q.source, q.binding, q.predicates, q.joins, [q.binding, *[b for b in _chosen(q) if b != q.binding]], limit), skip=skip, cursor=at if keyed and len(at) == 2 else None, **_scope(params))
    found, out = _answer(rows, began)
    more = len(found) == limit
    cursor = encode_cursor(found[-1][q.binding]["mass"], found[-1][q.binding]["id"]) if more and keyed else encode_cursor(skip + limit) if more else None
    out["results"] = [{b: r[b] for b in _chosen(q)} for r in found]
    return out | {"next_cursor": cursor}


def _chosen(q: Query) -> list[str]:
    return [q.binding] if q.select is None else [q.select] if isinstance(q.select, str) else list(q.select)


@_guard("invalid_query")
def plan(index: Index, params: dict) -> dict:
    """query (an object): what will be done, and how many candidates there are."""
    if not isinstance(params.get("query"), dict):
        raise QueryError("query must be a versioned query object")
    p, e = index.plan(params["query"]), index.estimate(params["query"])
    return {
        "plan": {"execution": p.execution, "hydration": p.hydration, "required_terms": list(p.required_terms), "kind": p.kind, "name": p.name, "arity": p.arity, "query": p.query.to_map()},
        "estimate": {"value": e.value, "relation": e.relation}, "index": {"prefix": index.store.prefix.rstrip("_"), "shard_count": getattr(index, "shard_count", 1)},
    }


@_guard("invalid_hydration_request")
def hydrate(index: Index, params: dict) -> dict:
    """ecosystem, package_name, version, paths: the files, whole or refused."""
    names = [str(params[k]) for k in ("ecosystem", "package_name", "version")]
    if not index.table("package_versions").where(f"id = {index._hash(*names)}").limit(1).count():
        raise RequestError(404, "package_version_not_found", "package version not found")
    s = index.hydrate(*names, params.get("paths") or ("lib/**",))
    return {"files": s.files, "fingerprint": s.fingerprint, "package": list(s.package), "bytes": s.bytes, "complete": True}


def capabilities(index: Index | None = None, params: dict | None = None) -> dict:
    return model.capabilities() | {"search_modes": ["auto", "structural", "text", "regex"], "limits": {"page": MOST_ROWS}}


def health(index: Index, params: dict | None = None) -> dict:
    """Whether the index is of a format that can be read, and how many packages it has."""
    try:
        index.store.check_format()
    except RuntimeError as e:
        return {"status": "error", "reason": str(e)}
    return {"status": "ok", "format": schema.FORMAT_VERSION, "packages": index.table("packages").count(), "shards": getattr(index, "shard_count", 1)}


def packages(index: Index, params: dict | None = None) -> dict:
    """A page of packages by their number of fragments; over shards, packages of one name are counted together."""
    limit = page_size((params or {}).get("limit"), MOST_ROWS)
    return {"packages": [r.asDict() for r in index.package_counts().limit(limit).collect()]}


def stats(index: Index, params: dict | None = None) -> dict:
    return {"counts": index.stats()}


ENDPOINTS = {"search": search, "query": query, "plan": plan, "hydrate": hydrate, "capabilities": capabilities, "health": health, "packages": packages, "stats": stats}


def call(index: Index, endpoint: str, params: dict | None = None) -> tuple[int, str]:
    """HTTP status and JSON of a request."""
    try:
        if endpoint not in ENDPOINTS:
            raise RequestError(404, "not_found", f"no endpoint {endpoint!r}")
        return 200, json.dumps(ENDPOINTS[endpoint](index, params or {}), default=str)
    except RequestError as e:
        return e.status, json.dumps(e.body())
