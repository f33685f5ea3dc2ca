"""Facts of a parsed source: fragments, symbols, comments, calls; index terms and fingerprints of trees."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Collection
from json.encoder import encode_basestring
from operator import itemgetter
from typing import Any

from codequarry.functions.elixir import Atom, Node, ParseError, children, decode, encode, parse_with_comments, walk

DEFS = ("def", "defp", "defmacro", "defmacrop")
OTHER_DEFS = ("defdelegate", "defcallback", "defmacrocallback")
#: Forms of the syntax tree that are no calls, whatever their arity: operators, blocks and containers, and the words that define or bring in.
SYNTAX = {
    *". + - * / ++ -- <> == != =~ === !== < > <= >= && || and or not ! in |> = | :: => .. & ^ @ <- \\\\ when ** __block__ __aliases__ {} %{} % <<>> fn -> access charlist".split(),
    *DEFS, *OTHER_DEFS, *"defmodule defstruct do alias import require use quote unquote".split(),
}
#: What typespecs and module documentation call, by name and arity; the same names with other arities are calls.
NOISE = set(
    "doc/1 moduledoc/1 typedoc/1 spec/1 type/1 typep/1 callback/1 macrocallback/1 "
    "any/0 atom/0 binary/0 boolean/0 float/0 function/0 integer/0 list/0 map/0 none/0 non_neg_integer/0 number/0 pid/0 port/0 reference/0 term/0 timeout/0".split()
)
#: Attributes that document or type rather than hold a value.
TYPE_ATTRIBUTES = set("doc moduledoc typedoc spec type typep opaque callback macrocallback impl behaviour".split())
#: What marks generated sources near their beginning, and how many characters are looked at.
GENERATED_MARKS, GENERATED_HEAD = ("generated", "do not edit", "autogenerated", "auto-generated"), 2000
GENERATED_BYTES = 500_000


def is_call(n: Any) -> bool:
    return isinstance(n, Node) and n.args is not None


def pairs_do(args: list) -> list | None:
    """The keyword list with the do block of a call's arguments."""
    last = args[-1] if args else None
    if isinstance(last, list) and any(isinstance(p, Node) and p.form == "{}" and p.args and p.args[0] == Atom("do") for p in last):
        return last
    return None


def alias_name(n: Any) -> str | None:
    if isinstance(n, Node) and n.form == "__aliases__":
        return ".".join(n.args)
    return f":{n.name}" if isinstance(n, Atom) else None


def head(n: Any) -> tuple[str, str | None, int | None]:
    """kind, name and arity of a fragment's root."""
    if is_call(n) and n.form in DEFS and n.args:
        h = n.args[0]
        if isinstance(h, Node) and h.form == "when":
            h = h.args[0]
        if isinstance(h, Node) and isinstance(h.form, str):
            return n.form, h.form, len(h.args or [])
        return n.form, None, None
    if is_call(n) and n.form == "defmodule" and n.args:
        return "module", alias_name(n.args[0]), None
    return "expression", None, None


def plain(n: Any) -> Any:
    """The tree with pipes written as calls: a |> f(b) is f(a, b). Places stay."""
    if isinstance(n, list):
        return [plain(x) for x in n]
    if not isinstance(n, Node):
        return n
    form = plain(n.form) if isinstance(n.form, Node) else n.form
    args = None if n.args is None else [plain(x) for x in n.args]
    if form == "|>" and len(args) == 2 and isinstance(args[1], Node) and not (isinstance(args[1].form, str) and args[1].form in ("__aliases__", "fn")):
        right = args[1]
        return Node(right.form, [args[0], *(right.args or [])], right.line or n.line, right.column, right.end)
    return Node(form, args, n.line, n.column, n.end)


def mass(n: Any) -> int:
    return sum(1 for x in walk(n) if not isinstance(x, list))


def last_line(n: Any) -> int:
    return max([x.end or x.line for x in walk(n) if isinstance(x, Node)] or [0])


def _normal(n: Any, names: dict[str, str]) -> Any:
    """A value in which variables count by order of first sight and places don't count."""
    if isinstance(n, list):
        return ["l", *(_normal(x, names) for x in n)]
    if isinstance(n, Atom):
        return ["t", n.name]
    if not isinstance(n, Node):
        return ["v", type(n).__name__, n]
    if n.args is None:
        return ["x", names.setdefault(str(n.form), f"v{len(names)}")]
    return ["n", _normal(n.form, names) if isinstance(n.form, Node) else n.form, *(_normal(x, names) for x in n.args)]


def exact_hash(n: Any) -> str:
    """SHA-256 of the normal form: renamed variables and pipes don't change it, literals do."""
    return hashlib.sha256(json.dumps(_normal(plain(n), {}), ensure_ascii=False).encode()).hexdigest()


def sub_hashes(n: Any, least: int = 4) -> list[int]:
    """64-bit hashes of the sub-trees of at least so many nodes, each once, sorted."""
    return sorted({int(exact_hash(x)[:16], 16) - (1 << 63) for x in walk(plain(n)) if isinstance(x, Node) and mass(x) >= least})


def term_of(n: Any) -> list[str]:
    """Index terms of one node by itself."""
    if isinstance(n, Atom):
        return [f"atom:{n.name}"]
    if isinstance(n, str):
        return [f"string:{n[:64]}"]
    if isinstance(n, int | float):
        return [f"number:{n}"]
    if not isinstance(n, Node) or n.args is None:
        return []
    if isinstance(n.form, Node):
        if n.form.form == "." and len(n.form.args) == 2 and (target := alias_name(n.form.args[0])):
            name = f"{target}.{n.form.args[1]}"
            return ["node:call", f"call.remote:{name}/{len(n.args)}", f"call.remote.name:{name}"]
        return ["node:call"]
    if n.form == "__aliases__":
        return [f"alias:{'.'.join(n.args)}"]
    kind, name, arity = head(n)
    if kind in DEFS:
        return [f"node:{kind}", "node:def_like", f"def.visibility:{'private' if kind.endswith('p') else 'public'}", *([f"def.name:{name}"] if name else [])]
    if kind == "module":
        return ["node:module"]
    return [f"node:{n.form}", f"call.local:{n.form}/{len(n.args)}"]


def terms(n: Any) -> list[str]:
    """Index terms of a whole tree, sorted."""
    return sorted({t for x in walk(plain(n)) for t in term_of(x)})


def generated(path: str, source: str) -> bool:
    parts = path.split("/")
    start = source[:GENERATED_HEAD].lower()
    return "generated" in parts or "gen" in parts or any(p.endswith(".pb.ex") for p in parts) or any(m in start for m in GENERATED_MARKS) or len(source.encode()) >= GENERATED_BYTES


_encoded = json.JSONEncoder(ensure_ascii=False).encode


def _quoted(x: Any) -> str:
    return encode_basestring(x) if type(x) is str else _encoded(x)


_NONE: frozenset = frozenset()


#: Characters of normal forms, and what terms and hashes count beside them, that a worker keeps of the shapes it has seen.
MOST_KEPT = 1 << 25


class _Shape:
    """A plain tree without its places, each made once: mass, normal form, index terms and hashes of sub-trees.

    In the normal form variables stand by name between zero signs, which JSON has nowhere else, and get their numbers when it is hashed.
    """

    __slots__ = ("key", "node", "below", "mass", "normal", "terms", "listed", "_hashes", "_sorted", "_exact")

    def __init__(self, key: tuple, node: Any, below: list[_Shape]):
        self.key, self.node, self.below = key, node, below
        self.mass = (not isinstance(node, list)) + sum([x.mass for x in below])
        self.terms = frozenset(term_of(node)).union(*[x.terms for x in below])
        self.listed = sorted(self.terms)
        self.normal = self._normal()
        self._hashes = self._sorted = self._exact = None

    def _normal(self) -> str:
        n = self.node
        if isinstance(n, Node):
            if n.args is None:
                return f'["x", \x00{n.form}\x00]'
            return f'["n", {", ".join([*([] if isinstance(n.form, Node) else [_quoted(n.form)]), *[x.normal for x in self.below]])}]'
        if isinstance(n, list):
            return f'[{", ".join(["\"l\"", *[x.normal for x in self.below]])}]'
        if isinstance(n, Atom):
            return f'["t", {_quoted(n.name)}]'
        return f'["v", "{type(n).__name__}", {_quoted(n)}]'

    def exact(self) -> str:
        """exact_hash of the tree."""
        if self._exact is None:
            names: dict[str, str] = {}
            parts = self.normal.split("\x00")
            for i in range(1, len(parts), 2):
                name = parts[i]
                parts[i] = names.get(name) or names.setdefault(name, f'"v{len(names)}"')
            self._exact = hashlib.sha256("".join(parts).encode()).hexdigest()
        return self._exact

    def hashes(self) -> frozenset:
        if self._hashes is None:
            sets = [h for x in self.below if (h := x.hashes())]
            if self.mass >= 4 and isinstance(self.node, Node):
                sets.append((int(self.exact()[:16], 16) - (1 << 63),))
            self._hashes = _NONE if not sets else sets[0] if len(sets) == 1 and type(sets[0]) is frozenset else _NONE.union(*sets)
        return self._hashes

    def sorted_hashes(self) -> list[int]:
        if self._sorted is None:
            self._sorted = sorted(self.hashes())
        return self._sorted


class _Shapes(dict):
    """Shapes by form and by the shapes below them. A worker keeps them from source to source: most sub-trees come again."""

    kept, era = 0, object()

    def start(self) -> None:
        """To be called between sources: lets go of all if there are too many. era: since when none were."""
        if self.kept > MOST_KEPT:
            self.clear()
            self.kept, self.era = 0, object()

    def of(self, key: tuple, node: Any, below: list[_Shape]) -> _Shape:
        """node: a tree of that shape; it is made plain here."""
        form = below[0].node if isinstance(node, Node) and isinstance(key[0], _Shape) else getattr(node, "form", None)
        args = [x.node for x in (below[1:] if isinstance(form, Node) else below)]
        if isinstance(node, Node):
            node = Node(form, None if node.args is None else args)
        elif isinstance(node, list):
            node = args
        found = self[key] = _Shape(key, node, below)
        self.kept += len(found.normal) + 100 * (1 + len(found.terms)) + 40 * found.mass
        return found


_shapes = _Shapes()


def _gathered(tree: Any, shaped: bool, encoded: bool) -> tuple[list[tuple], tuple, list[tuple]]:
    """(node, mass, last line, JSON, plain shape) of each Node, in the order of walk(), and the same of the tree; each made from those below it.

    Then the functions that a worker keeps: place in the list, number of nodes, node. What lies in them is made once.
    """
    out: list = []
    functions: list = []
    shapes = _shapes
    shapes.start()
    keeping = shaped and encoded

    def visit(n):
        kind = type(n)
        if kind is Node:
            at = len(out)
            if n.kept is not None and keeping:
                kept = n.kept
                if kept.era is not shapes.era:
                    made = _gathered(Node(n.form, n.args, n.line, n.column, n.end), True, True)[0]
                    made[0] = (n, *made[0][1:])
                    kept.gathered, kept.candidates, kept.era = made, None, shapes.era
                out.extend(kept.gathered)
                functions.append((at, len(out) - at, n))
                return out[at]
            out.append(None)
            form, given = n.form, n.args
            formed = visit(form) if type(form) is Node else None
            if given is None and formed is None:
                text = f'{{"f": {encode_basestring(form)}, "a": null, "m": [{n.line}, {n.column}, {"null" if n.end is None else n.end}]}}' if encoded else None
                shape = None
                if shaped:
                    key = ("x", form)
                    shape = shapes.get(key) or shapes.of(key, n, [])
                found = out[at] = (n, 1, n.end or n.line, text, shape)
                return found
            args = [visit(x) for x in given or ()]
            below = args if formed is None else [formed, *args]
            mass_, last, text, shape = 1, n.end or n.line, None, None
            for x in below:
                mass_ += x[1]
                if x[2] > last:
                    last = x[2]
            if encoded:
                inner = "null" if given is None else f"[{', '.join([x[3] for x in args])}]"
                text = f'{{"f": {encode_basestring(form) if formed is None else formed[3]}, "a": {inner}, "m": [{n.line}, {n.column}, {"null" if n.end is None else n.end}]}}'
            if shaped:
                under = [x[4] for x in below]
                key = (form if formed is None else formed[4], *(under if formed is None else under[1:]))
                node = n
                if form == "|>" and len(args) == 2 and type(args[1][0]) is Node and (right := args[1][4]).node.form not in ("__aliases__", "fn"):
                    # a |> f(b) is f(a, b)
                    node = right.node if right.node.args is not None else Node(right.node.form, [])
                    first = right.key[1] if right.key[0] == "x" and right.node.args is None else right.key[0]
                    rest = right.key[1:] if right.node.args is not None else ()
                    key = (first, args[0][4], *rest)
                    under = [*([first] if type(first) is _Shape else []), args[0][4], *rest]
                elif given is None:
                    key = ("x", key)
                shape = shapes.get(key) or shapes.of(key, node, under)
            found = out[at] = (n, mass_, last, text, shape)
            return found
        if kind is list:
            args = [visit(x) for x in n]
            text = f"[{', '.join([x[3] for x in args])}]" if encoded else None
            shape = None
            if shaped:
                under = [x[4] for x in args]
                key = (list, *under)
                shape = shapes.get(key) or shapes.of(key, n, under)
            return n, sum([x[1] for x in args]), max([x[2] for x in args], default=0), text, shape
        text = (f'{{"t": {_quoted(n.name)}}}' if kind is Atom else _quoted(n)) if encoded else None
        shape = None
        if shaped:
            key = (kind, n.name if kind is Atom else repr(n) if kind is float else n)
            shape = shapes.get(key) or shapes.of(key, n, [])
        return n, 1, 0, text, shape

    whole = visit(tree)
    visit = None  # a function that holds itself, and all this, would wait for the garbage collector
    return out, whole, functions


def fragments(path: str, source: str, tree: Any, *, min_mass: int = 15, generated_min_mass: int | None = None, fields: Collection[str] | None = None, kinds: Collection[str] | None = None) -> list[dict]:
    """Fragment rows of one file, in the order of their places. Trees are encoded as JSON.

    fields: what is asked for, so that hashes, terms and trees that aren't need not be made. kinds: no other fragments become rows.
    """
    if generated_min_mass and generated(path, source):
        min_mass = max(min_mass, generated_min_mass)
    want = {"exact_hash", "sub_hashes", "terms", "ast"} if fields is None else set(fields)
    hashed = bool(want & {"exact_hash", "sub_hashes"})
    return _rows(_gathered(tree, hashed or "terms" in want, "ast" in want)[0], min_mass, kinds, hashed)


def _candidates(known: list[tuple], kinds: Collection[str] | None) -> tuple[list[tuple], int, list[tuple], list[int]]:
    """(place among them, row, kind, name, arity) of nodes that may be fragments, how many there are of any kind, modules, and lines of definitions."""
    found, modules, defs = [], [], []
    order = 0
    for row in known:
        n = row[0]
        form = n.form
        if n.args is None or not n.line or form == "__aliases__" or form == "->" or form == ".":
            continue
        order += 1
        kind, name, arity = "expression", None, None
        if form in DEFS or form == "defmodule":
            kind, name, arity = head(n)
        if kind == "module":
            modules.append((n.line, n.end or 999_999, name))
        if kind in DEFS:
            defs.append(n.line)
        if kinds is None or kind in kinds:
            found.append((order, row, kind, name, arity))
    return found, order, modules, defs


def _parts(known: list[tuple], functions: list[tuple]):
    """Runs of rows between functions, and the functions, in order: (rows, function or None)."""
    at = 0
    for begin, many, n in functions:
        if begin > at:
            yield known[at:begin], None
        yield None, n
        at = begin + many
    if at < len(known):
        yield known[at:], None


def _rows(known: list[tuple], min_mass: int, kinds: Collection[str] | None, hashed: bool, functions: list[tuple] | tuple = ()) -> list[dict]:
    """functions: those of _gathered(), if all kinds are asked for."""
    modules, defs, found = [], [], []
    before = 0
    for rows, n in _parts(known, functions):
        if n is None:
            made, many, inner, starts = _candidates(rows, kinds)
            found += [(before + c[0], _row(*c, hashed)) for c in made if c[1][1] >= min_mass]
        else:
            if n.kept.candidates is None:
                n.kept.candidates = _kept_rows(n.kept.gathered)
            made, many, inner, starts = n.kept.candidates
            found += [(before + c[0], c[1].copy()) for c in made if c[1]["mass"] >= min_mass]
        before += many
        modules += inner
        defs += starts
    starts = sorted(set(defs))
    full = _nested(modules)
    within: dict[int, str | None] = {}
    out = []
    for order, row in found:
        line = row["line"]
        if row["kind"] in DEFS:
            after = bisect_right(starts, line)
            row["end_line"] = starts[after] - 1 if after < len(starts) else 999_999
        if line not in within:
            within[line] = _module_at(full, line)
        row["ordinal"], row["module"] = order, within[line]
        out.append(row)
    return out


def _row(order: int, row: tuple, kind: str, name: str | None, arity: int | None, hashed: bool) -> dict:
    """A fragment's row but for what depends on the file around it: module and end_line."""
    n, m, last, text, shape = row
    out = {"ordinal": order, "kind": kind, "module": None, "name": name, "arity": arity, "line": n.line, "end_line": None, "last_line": last, "mass": m}
    if hashed:
        out["exact_hash"] = shape.exact()
        out["sub_hashes"] = shape.sorted_hashes()
    if shape is not None:
        out["terms"] = shape.listed
    if text is not None:
        out["ast"] = text
    return out


def _kept_rows(known: list[tuple]) -> tuple[list[tuple], int, list[tuple], list[int]]:
    """_candidates() of a function that is kept, as rows. Their "places" are the function's terms, and what takes a row's own out of a list like it."""
    made, many, inner, starts = _candidates(known, None)
    listed = known[0][4].listed
    place = {t: i for i, t in enumerate(listed)}
    rows = []
    for c in made:
        row = _row(*c, True)
        if len(row["terms"]) > 1 and place.keys() >= set(row["terms"]):  # a pipe's right side alone has others
            row["places"] = listed, itemgetter(*[place[t] for t in row["terms"]])
        rows.append((c[0], row))
    return rows, many, inner, starts


def _nested(modules: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Modules with the names of those around them before their own."""
    out: list[tuple[int, int, str]] = []
    for a, b, name in sorted(modules, key=lambda m: m[0]):
        around = [q for x, y, q in out if x < a and b <= y]
        out.append((a, b, f"{around[-1]}.{name}" if around and name else name))
    return out


def _module_at(full: list[tuple[int, int, str]], line: int) -> str | None:
    inside = [(a, q) for a, b, q in full if a < line <= b]
    return max(inside)[1] if inside else None


def _marks(calls: list[Node]) -> list[tuple]:
    """What calls of a plain tree say of symbols, whatever is around them: (sort, kind, module, name, arity, node). Their order is that of walk()."""
    out: list[tuple] = []
    heads = set()
    for n in calls:
        form = n.form
        if form == "alias" and n.args and (name := alias_name(n.args[0])):
            short = name.rsplit(".", 1)[-1]
            if len(n.args) > 1 and isinstance(n.args[1], list):
                short = next((alias_name(p.args[1]) for p in n.args[1] if isinstance(p, Node) and p.args[0] == Atom("as")), short)
            out.append(("alias", None, name, short, None, n))
        if form == "defmodule" and n.args:
            out.append(("span", None, None, head(n)[1], None, n))
        kind, name, arity = head(n) if form in DEFS or form == "defmodule" else ("expression", None, None)
        if kind == "module":
            out.append(("module", "module", None, name, None, n))
        elif kind in DEFS and name:
            out.append(("def", kind, None, name, arity, n))
            h = n.args[0].args[0] if n.args[0].form == "when" else n.args[0]
            heads.add(id(h))
        elif form in OTHER_DEFS and n.args and isinstance(n.args[0], Node) and isinstance(n.args[0].form, str):
            out.append(("def", form, None, n.args[0].form, len(n.args[0].args or []), n))
            heads.add(id(n.args[0]))
        elif form == "@" and n.args and isinstance(n.args[0], Node):
            name = n.args[0].form
            if n.args[0].args and name not in TYPE_ATTRIBUTES:
                out.append(("def", "attribute", None, f"@{name}", None, n))
            elif name not in TYPE_ATTRIBUTES and n.args[0].args is None:
                out.append(("here", "module_attribute", None, f"@{name}", None, n))
            heads.add(id(n.args[0]))
        elif form == "__aliases__":
            out.append(("ref", "alias", None, ".".join(n.args), None, n))
        elif isinstance(form, Node) and form.form == "." and len(form.args) == 2:
            if target := alias_name(form.args[0]):
                out.append(("ref", "remote_call", target, form.args[1], len(n.args), n))
        elif isinstance(form, str) and form not in SYNTAX and f"{form}/{len(n.args)}" not in NOISE and not form.startswith("sigil_") and id(n) not in heads:
            out.append(("ref", "local_call", None, form, len(n.args), n))
    return out


def _calls(nodes) -> list[Node]:
    return [n for n in nodes if type(n) is Node and n.args is not None]


def _all_marks(tree: Any, known: list[tuple], functions: list[tuple]) -> list[tuple]:
    """_marks() of a file's plain tree, of which those in functions are made once."""
    out: list[tuple] = []
    for rows, n in _parts(known, functions):
        if n is not None:
            if n.kept.marks is None:
                n.kept.marks = _marks(_calls(walk(plain(n))))
            out += n.kept.marks
            continue
        calls = _calls([row[0] for row in rows])
        if any(c.form == "|>" for c in calls):
            return _marks(_calls(walk(plain(tree))))
        out += _marks(calls)
    return out


def symbols(tree: Any, nodes: list[Node] | None = None, marks: list[tuple] | None = None) -> tuple[list[dict], list[dict], list[dict]]:
    """Definitions, references and call edges of one file. nodes: the tree's, if they are known, in the order of walk(). marks: _all_marks() of it, if they are."""
    if marks is None:
        calls = _calls(walk(tree) if nodes is None else nodes)
        if any(n.form == "|>" for n in calls):
            calls = _calls(walk(plain(tree)))
        marks = _marks(calls)
    full = _nested([(n.line, n.end or 999_999, name) for sort, _, _, name, _, n in marks if sort == "span"])
    aliases = {short: name for sort, _, name, short, _, _ in marks if sort == "alias"}
    defs: list[dict] = []
    refs: list[dict] = []
    edges: list[dict] = []

    def row(kind, module, name, arity, n):
        q = f"{module}.{name}" if module and kind != "module" else name
        q = f"{q}/{arity}" if arity is not None else q
        return {"kind": kind, "module": module, "name": name, "arity": arity, "qualified_name": q, "line": n.line, "column": n.column}

    def resolved(name):
        first, _, rest = name.partition(".")
        return aliases.get(first, first) + (f".{rest}" if rest else "")

    within: dict[int, str | None] = {}

    def module_at(line):
        if line not in within:
            within[line] = _module_at(full, line)
        return within[line]

    for sort, kind, module, name, arity, n in marks:
        if sort == "ref":
            if kind == "alias":
                refs.append(row(kind, None, resolved(name), None, n))
            elif kind == "remote_call":
                refs.append(row(kind, resolved(module) if module[0] != ":" else module, name, arity, n))
            else:
                refs.append(row(kind, None, name, arity, n))
        elif sort == "def":
            defs.append(row(kind, module_at(n.line), name, arity, n))
        elif sort == "module":
            q = next((q for a, _, q in full if a == n.line), name)
            defs.append(row("module", q, q, None, n))
        elif sort == "here":
            refs.append(row(kind, module_at(n.line), name, arity, n))
    # calls lie in the definition that begins last before them
    bodies = sorted([d for d in defs if d["kind"] in DEFS], key=lambda d: d["line"])
    known = {(d["module"], d["name"], d["arity"]) for d in bodies}
    last: dict[int, dict | None] = {}
    for r in refs:
        if r["kind"] not in ("local_call", "remote_call"):
            continue
        line = r["line"]
        if line not in last:
            last[line] = next((d for d in reversed(bodies) if d["line"] <= line and d["module"] == module_at(line)), None)
        caller = last[line]
        if caller is None:
            continue
        module = r["module"] if r["kind"] == "remote_call" else caller["module"]
        q = f"{module}.{r['name']}/{r['arity']}" if module else f"{r['name']}/{r['arity']}"
        edges.append({
            "caller_qualified_name": caller["qualified_name"], "callee_qualified_name": q, "callee_module": module, "callee_name": r["name"], "callee_arity": r["arity"],
            "external": r["kind"] == "remote_call" and (module, r["name"], r["arity"]) not in known, "line": r["line"], "column": r["column"],
        })
    return defs, refs, edges


def symbol_sets(tree: Any) -> dict[str, list[str]]:
    """Of a file, sorted and each once: defs, refs, modules, functions, aliases, structs and atoms."""
    defs, refs, _ = symbols(tree)
    nodes = list(walk(tree))
    structs = (alias_name(n.args[0]) for n in nodes if is_call(n) and n.form == "%" and n.args)
    found = {
        "defs": (d["name"] if d["kind"] == "module" else f"{d['name']}/{d['arity']}" for d in defs if d["kind"] == "module" or d["kind"] in DEFS),
        "refs": (r["qualified_name"] for r in refs if r["kind"] in ("local_call", "remote_call")),
        "modules": (d["name"] for d in defs if d["kind"] == "module"),
        "functions": (d["name"] for d in defs if d["kind"] in DEFS),
        "aliases": (alias_name(n.args[0]) for n in nodes if is_call(n) and n.form == "alias" and n.args),
        "structs": structs,
        "atoms": (n.name for n in nodes if isinstance(n, Atom)),
    }
    return {k: sorted({x for x in v if x}) for k, v in found.items()}


def comment_rows(comments: list[tuple[str, int, int]]) -> list[dict]:
    return [{"text": t, "line": line, "column": column} for t, line, column in comments]


def tree_rows(tree: Any) -> list[dict]:
    """pre, post, depth, role, kind, label and line of each node. Leaves have post equal to pre."""
    out: list[dict] = []
    count = 0

    def visit(n, role, depth):
        nonlocal count
        count += 1
        pre, below = count, children(n)
        kind = "list" if isinstance(n, list) else "variable" if isinstance(n, Node) and n.args is None else "call" if isinstance(n, Node) else "literal"
        label = "[]" if isinstance(n, list) else (n.form if isinstance(n.form, str) else ".") if isinstance(n, Node) else n.name if isinstance(n, Atom) else str(n)
        row = {"pre": pre, "post": pre, "depth": depth, "role": role, "kind": kind, "label": label, "line": getattr(n, "line", 0) or None}
        out.append(row)
        for i, x in enumerate(below):
            visit(x, f"child{i}", depth + 1)
        if below:
            count += 1
            row["post"] = count

    visit(tree, "root", 0)
    return out


def extract(path: str, source: str, *, min_mass: int = 15, generated_min_mass: int | None = None) -> dict | None:
    """All facts of one source, or None if it can't be parsed."""
    try:
        tree, comments = parse_with_comments(source, functions=True)
    except (ParseError, IndexError, RecursionError):
        return None
    if generated_min_mass and generated(path, source):
        min_mass = max(min_mass, generated_min_mass)
    known, whole, functions = _gathered(tree, True, True)
    defs, refs, edges = symbols(tree, marks=_all_marks(tree, known, functions))
    return {
        "ast": whole[3], "comments": comment_rows(comments), "definitions": defs, "references": refs, "edges": edges,
        "fragments": _rows(known, min_mass, None, True, functions),
    }


class _Block:
    """Fragments of a kept function, of at least a mass, as lists of fields; of those with the same text on the same line the first. What the file around it decides is left out."""

    __slots__ = ("orders", "fields", "defs", "spans", "tree", "at", "size", "listed", "takes")

    def __init__(self, made: list[tuple], least: int, tree: str):
        self.spans, kept, seen = [], [], set()
        for order, row in made:
            if row["mass"] < least:
                continue
            new = (key := (row["line"], row["exact_hash"])) not in seen
            seen.add(key)
            self.spans.append((row["kind"] in DEFS, row["line"], row["last_line"], row["mass"], len(kept) if new else None))
            if new:
                kept.append((order, row))
        self.orders = [order for order, _ in kept]
        self.fields = {n: [row[n] for _, row in kept] for n in ("kind", "name", "arity", "line", "last_line", "mass", "exact_hash", "sub_hashes")}
        self.defs = [i for i, (_, row) in enumerate(kept) if row["kind"] in DEFS]
        self.tree = tree if tree.isascii() else tree.encode()
        self.at, self.size = [], []
        at = 0
        for _, row in kept:
            text = row["ast"] if tree.isascii() else row["ast"].encode()
            at = self.tree.index(text, at)
            self.at.append(at)
            self.size.append(len(text))
        shared = [row["places"] for _, row in kept if "places" in row]
        self.listed = shared[0][0] if shared else []
        self.takes = [row["places"][1] if "places" in row else row["terms"] for _, row in kept]


#: Fields of fragments as they are gathered by columns().
COLUMNS = ("ordinal", "kind", "module", "name", "arity", "line", "end_line", "last_line", "mass", "exact_hash", "sub_hashes", "terms", "ast_at", "ast_size")


#: Kinds of facts that fragments hold.
_HELD = ("definitions", "references", "comments", "edges")


def owner_of(spans: list[tuple[int, int, int, int | None]], line: int) -> int | None:
    """The place of the smallest fragment around a line, the first of equal ones. spans: line, end, mass and place of each; None if it wasn't kept."""
    best = least = None
    for first, end, mass, place in spans:
        if first <= line <= end and (least is None or mass < least):
            best, least = place, mass
    return best


def _columns(source: str, into: dict[str, list], min_mass: int) -> dict | None:
    """extract(), but for fragments: those are added to the lists of into by field, once for the same text on the same line, without a row each.

    Their terms are places in "terms", their trees places and sizes in bytes of "ast". Other facts have the place of their owner, the smallest
    fragment around them. Functions that a worker has seen are added whole.
    """
    try:
        tree, comments = parse_with_comments(source, functions=True)
    except (ParseError, IndexError, RecursionError):
        return None
    known, whole, functions = _gathered(tree, True, True)
    defs, refs, edges = symbols(tree, marks=_all_marks(tree, known, functions))
    text = whole[3]
    plain_text = text.isascii()
    text = text if plain_text else text.encode()
    blocks, modules, begins = [], [], []
    before = 0
    for rows, n in _parts(known, functions):
        if n is None:
            made, many, inner, starts = _candidates(rows, None)
            blocks.append((before, [c for c in made if c[1][1] >= min_mass], None))
        else:
            if n.kept.candidates is None:
                n.kept.candidates = _kept_rows(n.kept.gathered)
            made, many, inner, starts = n.kept.candidates
            if n.kept.blocks is None or n.kept.blocks[0] is not made or n.kept.blocks[1] != min_mass:
                n.kept.blocks = made, min_mass, _Block(made, min_mass, n.kept.gathered[0][3])
            blocks.append((before, None, n.kept.blocks[2]))
        before += many
        modules += inner
        begins += starts
    begins = sorted(set(begins))
    full = _nested(modules)
    within: dict[int, str | None] = {}

    def module_at(line):
        if line not in within:
            within[line] = _module_at(full, line)
        return within[line]

    def end_of(line):
        after = bisect_right(begins, line)
        return begins[after] - 1 if after < len(begins) else 999_999

    number: dict[str, int] = {}
    seen: set = set()
    spans: list[tuple] = []
    count = at = 0
    for before, made, block in blocks:
        if block is None:
            for c in made:
                row = _row(*c, True)
                line, end = row["line"], None
                if row["kind"] in DEFS:
                    end = end_of(line)
                new = (key := (line, row["exact_hash"])) not in seen
                spans.append((line, end if end is not None else row["last_line"], row["mass"], count if new else None))
                if not new:
                    continue
                seen.add(key)
                count += 1
                piece = row["ast"] if plain_text else row["ast"].encode()
                at = text.index(piece, at)
                row["ordinal"], row["module"], row["end_line"], row["ast_at"], row["ast_size"] = before + c[0], module_at(line), end, at, len(piece)
                row["terms"] = [number.setdefault(t, len(number)) for t in row["terms"]]
                for n in COLUMNS:
                    into[n].append(row[n])
            continue
        tree_ = block.tree if plain_text or type(block.tree) is bytes else block.tree.encode()
        at = text.index(tree_, at)
        ends = [None] * len(block.orders)
        for i in block.defs:
            ends[i] = end_of(block.fields["line"][i])
        into["ordinal"] += [before + x for x in block.orders]
        into["module"] += [module_at(x) for x in block.fields["line"]]
        into["end_line"] += ends
        into["ast_at"] += [at + x for x in block.at]
        into["ast_size"] += block.size
        for n, values in block.fields.items():
            into[n] += values
        placed = [number.setdefault(t, len(number)) for t in block.listed]
        into["terms"] += [[number.setdefault(t, len(number)) for t in take] if type(take) is list else take(placed) for take in block.takes]
        spans += [(line, end_of(line) if is_def else last, m, None if i is None else count + i) for is_def, line, last, m, i in block.spans]
        count += len(block.orders)
    found = {"ast": whole[3], "comments": comment_rows(comments), "definitions": defs, "references": refs, "edges": edges, "fragments": count, "terms": list(number)}
    # functions and modules hold facts; an open end is an expression's own
    owners: dict[int, int | None] = {}
    for k in _HELD:
        for x in found[k]:
            if (line := x["line"]) not in owners:
                owners[line] = owner_of(spans, line)
            x["owner"] = owners[line]
    return found


#: A file's first line, if it begins a module with a simple name; and what strings begin with, in which the name may stand without being seen.
_MODULE, _HIDES = re.compile(r"defmodule ([A-Z][A-Za-z0-9_]*) do"), re.compile("[\"'~?\\\\]")
#: Modules that came again under other names, by what is left of them without name and comments; and hashes of those seen once.
_MODULES: dict[tuple, _Module | None] = {}
_ONCE: set[int] = set()
#: Characters of trees of such modules that a worker keeps, of one module's text, and how many are known to have come once.
MOST_MODULES, LONGEST_MODULE, MOST_ONCE = 1 << 23, 1 << 13, 1 << 16
_modules_kept = 0


class _Module:
    """A module's facts, of which those under another name of the same length are made by putting it in the place of the first.

    The name stands nowhere else in the text but in comments, begins with a capital, and no word that facts are made with has one: where it is in a fact, it is the module's.
    Hashes of trees with the name in them are made anew. Anything else than expected raises ValueError.
    """

    def __init__(self, name: str, lists: dict[str, list], got: dict):
        if not got["ast"].isascii():
            raise ValueError("places of trees are in bytes")
        self.name, self.lists, self.got = name, lists, got
        self.tree = self._halves(got["ast"])
        self.normals: dict[str, int] = {}  # normal forms with the name, by their places in digests
        self.hashed = []
        for i, (at, size) in enumerate(zip(lists["ast_at"], lists["ast_size"])):
            if name not in (piece := got["ast"][at : at + size]):
                continue
            below = plain(decode(json.loads(piece)))
            own = self._normal(below)
            subs = [self._normal(x) for x in walk(below) if isinstance(x, Node) and mass(x) >= 4]
            mine = [n for n in dict.fromkeys(subs) if name in n]
            rest = set(lists["sub_hashes"][i]) - {self._number(self._digest(n)) for n in mine}
            if self._digest(own) != lists["exact_hash"][i] or sorted(rest | {self._number(self._digest(n)) for n in mine}) != lists["sub_hashes"][i]:
                raise ValueError("hashes differ")
            self.hashed.append((i, self._place(own), [self._place(n) for n in mine], rest))
        self.halves = [self._halves(n) for n in self.normals]
        texts = [x for n in ("kind", "module", "name") for x in lists[n]] + got["terms"] + [v for k in _HELD if k != "comments" for r in got[k] for v in r.values()]
        self.named = sorted({x for x in texts if type(x) is str and name in x})
        self.rows = {k: [(r, [n for n, v in r.items() if type(v) is str and name in v]) for r in got[k]] for k in _HELD if k != "comments"}

    @staticmethod
    def _normal(n: Any) -> str:
        return json.dumps(_normal(n, {}), ensure_ascii=False)

    @staticmethod
    def _digest(normal: str) -> str:
        return hashlib.sha256(normal.encode()).hexdigest()

    @staticmethod
    def _number(digest: str) -> int:
        return int(digest[:16], 16) - (1 << 63)

    def _place(self, normal: str) -> int:
        return self.normals.setdefault(normal, len(self.normals))

    def _halves(self, whole: str) -> tuple[str, str]:
        before, after = whole.split(self.name)  # ValueError unless it is there once
        return before, after

    def put(self, name: str, comments: list[str], into: dict[str, list]) -> dict:
        sub = {x: x.replace(self.name, name) for x in self.named}
        digests = [hashlib.sha256(f"{a}{name}{b}".encode()).hexdigest() for a, b in self.halves]
        begin = len(into["exact_hash"])
        for n, values in self.lists.items():
            into[n] += [sub.get(x, x) for x in values] if n == "module" or n == "name" else values
        for i, own, mine, rest in self.hashed:
            into["exact_hash"][begin + i] = digests[own]
            into["sub_hashes"][begin + i] = sorted(rest.union([self._number(digests[p]) for p in mine]))
        found = {k: [r | {n: sub[r[n]] for n in names} if names else r for r, names in rows] for k, rows in self.rows.items()}
        found["comments"] = [r | {"text": t} for r, t in zip(self.got["comments"], comments)]
        found["ast"], found["fragments"], found["terms"] = name.join(self.tree), self.got["fragments"], [sub.get(x, x) for x in self.got["terms"]]
        return found


def columns(path: str, source: str, into: dict[str, list], *, min_mass: int = 15, generated_min_mass: int | None = None) -> dict | None:
    """_columns() of a source. A module that comes again under other names is parsed twice by a worker, and then no more."""
    global _modules_kept
    if generated_min_mass and generated(path, source):
        min_mass = max(min_mass, generated_min_mass)
    if source is None or len(source) > LONGEST_MODULE or (m := _MODULE.match(source)) is None:
        return _columns(source, into, min_mass)
    lines, comments = source[m.end() :].split("\n"), []
    if "#" in source:
        for k, x in enumerate(lines):
            if (sign := x.find("#")) >= 0:
                comments.append(x[sign:].rstrip("\r"))
                lines[k] = x[: sign + 1]
    name, bare = m[1], "\n".join(lines)
    if lines[0] or name in bare or len(name) > 60:
        return _columns(source, into, min_mass)
    key = len(name), min_mass, bare
    if (known := _MODULES.get(key)) is not None:
        return known.put(name, comments, into)
    if key in _MODULES or _HIDES.search(bare):
        return _columns(source, into, min_mass)
    if (mark := hash(key)) not in _ONCE:
        if len(_ONCE) >= MOST_ONCE:
            _ONCE.clear()
        _ONCE.add(mark)
        return _columns(source, into, min_mass)
    lists: dict[str, list] = {n: [] for n in COLUMNS}
    got = _columns(source, lists, min_mass)
    if got is not None:
        if _modules_kept > MOST_MODULES:
            _MODULES.clear()
            _modules_kept = 0
        try:
            _MODULES[key] = _Module(name, lists, got) if [c["text"] for c in got["comments"]] == comments else None
        except ValueError:
            _MODULES[key] = None
        _modules_kept += len(bare) + len(got["ast"])
        for n in COLUMNS:
            into[n] += lists[n]
    return got


def facts(kind: str, path: str, source: str, *, min_mass: int = 15, generated_min_mass: int | None = None, fields: Collection[str] | None = None, kinds: Collection[str] | None = None) -> list[dict]:
    """extract()'s rows of one kind, without the work for the others; none of a source that can't be parsed."""
    try:
        tree, comments = parse_with_comments(source, functions=True)
    except (ParseError, IndexError, RecursionError):
        return []
    if kind == "comments":
        return comment_rows(comments)
    if kind == "fragments":
        return fragments(path, source, tree, min_mass=min_mass, generated_min_mass=generated_min_mass, fields=fields, kinds=kinds)
    found = dict(zip(("definitions", "references", "edges"), symbols(tree)))[kind]
    return found if kinds is None else [r for r in found if r["kind"] in kinds]
