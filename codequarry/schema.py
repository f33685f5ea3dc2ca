"""The fourteen tables of an index, and the whitelist of fields that queries may name."""

from __future__ import annotations

FORMAT_VERSION, PARSER_VERSION = 3, 2

_SCOPE = "package_id long, package_version_id long, file_id long"
_SYMBOL = f"id long, {_SCOPE}, fragment_id long, kind string, module string, name string, arity int, qualified_name string, line int, column int"

TABLES = {
    "index_format": "id long, format_version int, parser_version int",
    "packages": "id long, ecosystem string, name string, metadata map<string,string>",
    "package_versions": "id long, package_id long, version string, source_ref string, checksum string, index_state string, metadata map<string,string>",
    "files": "id long, package_id long, package_version_id long, path string, source string, ast string, comments_text string, identifier_tokens string, sha256 string",
    "file_terms": f"{_SCOPE}, term_id long, tf int",
    "file_lengths": f"{_SCOPE}, len int",
    "terms": "id long, term string",
    "fragment_terms": "term_id long, fragment_id long, package_version_id long",
    "fragments": f"id long, {_SCOPE}, ordinal int, content_hash string, kind string, module string, name string, arity int, line int, end_line int, last_line int, mass int, exact_hash string, sub_hashes array<long>, ast string",
    "comments": f"id long, {_SCOPE}, fragment_id long, text string, line int, column int",
    "definitions": _SYMBOL,
    "references": _SYMBOL,
    "graph_nodes": f"id long, {_SCOPE}, fragment_id long, engine string, external_id string, kind string, module string, name string, arity int, qualified_name string, line int, column int, metadata map<string,string>",
    "call_edges": f"id long, {_SCOPE}, caller_node_id long, callee_node_id long, call_site_fragment_id long, caller_qualified_name string, callee_qualified_name string, line int, column int, metadata map<string,string>",
}
#: Tables stored by version, so that indexing a version again replaces its part.
BY_VERSION = ("files", "file_terms", "file_lengths", "fragments", "fragment_terms", "comments", "definitions", "references", "graph_nodes", "call_edges")

_SYMBOL_FIELDS = ("id", "package_id", "package_version_id", "file_id", "fragment_id", "kind", "module", "name", "arity", "qualified_name", "line", "column")
FIELDS = {
    "package": ("id", "ecosystem", "name", "metadata"),
    "package_version": ("id", "package_id", "version", "source_ref", "checksum", "index_state", "metadata"),
    "file": ("id", "package_id", "package_version_id", "path", "comments_text", "identifier_tokens", "sha256"),
    "fragment": ("id", "package_id", "package_version_id", "file_id", "kind", "module", "name", "arity", "line", "end_line", "mass"),
    "definition": _SYMBOL_FIELDS,
    "reference": _SYMBOL_FIELDS,
    "call_edge": ("id", "package_id", "package_version_id", "file_id", "caller_node_id", "callee_node_id", "call_site_fragment_id", "caller_qualified_name", "callee_qualified_name", "line", "column"),
}
TABLE_OF = {"package": "packages", "package_version": "package_versions", "file": "files", "fragment": "fragments", "definition": "definitions", "reference": "references", "call_edge": "call_edges"}
#: Association: the source it joins.
ASSOCIATIONS = {"fragment": {"definitions": "definition", "references": "reference", "calls": "call_edge"}, "definition": {"calls": "call_edge"}}
MOST_JOINS = {"fragment": 3, "definition": 1}
