"""Patterns over trees, and the similarity of trees.

In a pattern _ is any one tree, ... any number of arguments, and a variable any tree, the same at each
of its places. Pipes and calls are the same; places don't count. A Selector adds what must or must not stand
within, what must follow, comments, and guards over what variables bound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from codequarry.functions import code
from codequarry.functions.elixir import Atom, Node, ParseError, children, decode, parse, walk


def _dots(n: Any) -> bool:
    return isinstance(n, Node) and n.form == "..." and not n.args


def match(pattern: Any, tree: Any, bound: dict | None = None) -> dict | None:
    """What the pattern's variables bind in the tree, or None. Both must be plain (see code.plain)."""
    bound = {} if bound is None else bound
    if isinstance(pattern, Node) and pattern.args is None and isinstance(pattern.form, str):
        if pattern.form == "_":
            return bound
        if pattern.form in bound:
            return bound if same(bound[pattern.form], tree) else None
        return {**bound, pattern.form: tree}
    if isinstance(pattern, list):
        return _sequence(pattern, tree, bound) if isinstance(tree, list) else None
    if isinstance(pattern, Node):
        if not isinstance(tree, Node) or tree.args is None:
            return None
        if isinstance(pattern.form, Node) or isinstance(tree.form, Node):
            if not (isinstance(pattern.form, Node) and isinstance(tree.form, Node)):
                return None
            bound = match(pattern.form, tree.form, bound)
            if bound is None:
                return None
        elif pattern.form != tree.form:
            return None
        if pattern.form in code.DEFS and len(pattern.args) == 1 and len(tree.args) == 2:
            return _sequence(pattern.args, tree.args[:1], bound)  # a head alone goes with any body
        if pattern.form == "%{}":
            return _subset(pattern.args, tree.args, bound)
        return _sequence(pattern.args, tree.args, bound)
    return bound if type(pattern) is type(tree) and pattern == tree else None


def _sequence(patterns: list, trees: list, bound: dict) -> dict | None:
    if not patterns:
        return bound if not trees else None
    first, rest = patterns[0], patterns[1:]
    if _dots(first):
        for k in range(len(trees) + 1):
            found = _sequence(rest, trees[k:], bound)
            if found is not None:
                return found
        return None
    if not trees:
        return None
    found = match(first, trees[0], bound)
    return None if found is None else _sequence(rest, trees[1:], found)


def _subset(patterns: list, trees: list, bound: dict) -> dict | None:
    """Map patterns match maps with more keys."""
    if not patterns:
        return bound
    for i, t in enumerate(trees):
        found = match(patterns[0], t, bound)
        if found is not None and (found := _subset(patterns[1:], trees[:i] + trees[i + 1 :], found)) is not None:
            return found
    return None


def same(a: Any, b: Any) -> bool:
    if isinstance(a, Node) and isinstance(b, Node):
        return same(a.form, b.form) and (a.args is None) == (b.args is None) and same(a.args or [], b.args or [])
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


@lru_cache(1024)
def _compiled(pattern: str) -> Any:
    return code.plain(parse(pattern))


def compiled(pattern: Any) -> Any:
    """The plain tree of a pattern, given as text, as a tree, or as an encoded tree. Raises ParseError."""
    if isinstance(pattern, str):
        return _compiled(pattern)
    return code.plain(decode(pattern) if isinstance(pattern, dict) else pattern)


def is_code(text: str) -> bool:
    """Whether what is to be contained is code rather than text: not a bare word, and it parses to something."""
    if not text.strip() or all(c.isalnum() or c in "_#!?@.-" for c in text):
        return False
    try:
        tree = parse(text)
    except (ParseError, IndexError):
        return False
    return tree != Atom("nil") and not (isinstance(tree, Node) and tree.form == "__block__" and not tree.args)


def strictly_within(pattern: Any, tree: Any) -> bool:
    return any(match(pattern, x) is not None for c in children(tree) for x in walk(c))


def pushdown(pattern: Any) -> tuple[str | None, str | None, int | None]:
    """kind, name and arity that every match of the pattern has; the arity only if arguments are all _ or none."""
    kind, name, arity = code.head(pattern)
    if kind == "expression":
        return None, None, None
    if kind == "module":
        return kind, name if name else None, None
    if name is None or name == "_":
        return kind, None, None
    h = pattern.args[0]
    h = h.args[0] if h.form == "when" else h
    loose = all(isinstance(a, Node) and a.args is None and a.form == "_" for a in (h.args or []))
    return kind, name, arity if loose and h.args is not None and not any(_dots(a) for a in h.args) else None


def required_terms(pattern: Any) -> set[str]:
    """Terms that every tree matching the pattern has."""
    out: set[str] = set()
    for x in walk(pattern):
        if isinstance(x, Node) and (x.args is None or _dots(x)):
            continue
        for t in code.term_of(x):
            if isinstance(x, Node) and any(_dots(a) for a in x.args) and t.rsplit("/", 1)[-1].isdigit():
                continue  # an open number of arguments has no arity
            if t in ("def.name:_", "node:__block__", "call.local:__block__/0") or t.startswith(("node:__block__", "call.local:__block__")):
                continue
            out.add(t)
    return out


@dataclass
class Selector:
    """A pattern at the root (or anywhere, if deep) and conditions on the tree that it matches."""

    pattern: str = "_"
    contains: list[str] = field(default_factory=list)
    lacks: list[str] = field(default_factory=list)
    follows: tuple[str, str] | None = None
    comment: str | None = None
    guards: list[Callable[[dict], bool]] = field(default_factory=list)
    deep: bool = False
    first: bool = False

    def terms(self) -> set[str]:
        return set().union(*(required_terms(compiled(p)) for p in [self.pattern, *self.contains, *(self.follows or ())]))

    def matches(self, tree: Any, source_lines: str | None = None) -> list[tuple[Any, dict]]:
        """(node, bindings) of each match in a tree."""
        root = code.plain(tree)
        pattern, out = compiled(self.pattern), []
        if self.comment is not None and (source_lines is None or self.comment not in source_lines):
            return []
        for n in walk(root) if self.deep else [root]:
            bound = match(pattern, n)
            if bound is None or isinstance(n, list):
                continue
            if not all(strictly_within(compiled(c), n) for c in self.contains) or any(strictly_within(compiled(c), n) for c in self.lacks):
                continue
            if self.follows and not self._in_order(n):
                continue
            if all(g(bound) for g in self.guards):
                out.append((n, bound))
                if self.first:
                    break
        return out

    def _in_order(self, n: Any) -> bool:
        """Whether a match of the first pattern stands in a block before one of the second."""
        a, b = (compiled(p) for p in self.follows)
        for x in walk(n):
            if isinstance(x, Node) and x.form == "__block__":
                seen = False
                for y in x.args:
                    if seen and match(b, y) is not None:
                        return True
                    seen = seen or match(a, y) is not None
        return False


def edit_distance(a: Any, b: Any) -> int:
    """Ordered tree edit distance: relabel, put in, take out, 1 each (Zhang and Shasha)."""

    def flat(tree):
        labels, left, keys = [], [], {}

        def visit(n):
            firsts = [visit(c) for c in children(n)]
            labels.append(_label(n))
            left.append(firsts[0] if firsts else len(labels) - 1)
            keys[left[-1]] = len(labels) - 1
            return left[-1]

        visit(tree)
        return labels, left, sorted(keys.values())

    la, fa, ka = flat(code.plain(a))
    lb, fb, kb = flat(code.plain(b))
    if la == lb and fa == fb:
        return 0
    d = [[0] * len(lb) for _ in la]
    for i in ka:
        for j in kb:
            m, n = i - fa[i] + 2, j - fb[j] + 2
            f = [[0] * n for _ in range(m)]
            for x in range(1, m):
                f[x][0] = f[x - 1][0] + 1
            for y in range(1, n):
                f[0][y] = f[0][y - 1] + 1
            for x in range(1, m):
                for y in range(1, n):
                    p, q = x + fa[i] - 1, y + fb[j] - 1
                    if fa[p] == fa[i] and fb[q] == fb[j]:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[x - 1][y - 1] + (la[p] != lb[q]))
                        d[p][q] = f[x][y]
                    else:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[fa[p] - fa[i]][fb[q] - fb[j]] + d[p][q])
    return d[-1][-1]


def _label(n: Any) -> str:
    if isinstance(n, list):
        return "[]"
    if isinstance(n, Node):
        return "variable" if n.args is None else n.form if isinstance(n.form, str) else "call"
    return f":{n.name}" if isinstance(n, Atom) else repr(n)


def similarity(a: Any, b: Any, least: float = 0.0) -> float:
    """1 less the edit distance over the larger tree's size.

    If the sizes alone show it to be under least, what they allow at most is returned instead: each edit changes the size by one at most.
    """
    m, n = sum(1 for _ in walk(code.plain(a))), sum(1 for _ in walk(code.plain(b)))
    most = 1 - abs(m - n) / max(m, n)
    return most if most < least else 1 - edit_distance(a, b) / max(m, n)
