"""A parser for the subset of Elixir that the engine indexes.

Trees are Node(form, args): a variable has args None, a call or operator a list. A remote call's form
is itself a Node "." of target and name. Literals are int, float, str, Atom, list; a pair is a Node "{}".
Covered: modules, definitions, blocks with do/else/rescue/catch/after, clauses, anonymous
functions, captures, pipes and the other operators, keyword lists, maps, structs, binaries, strings with
interpolation, heredocs, sigils, module attributes, access by brackets. What lies beyond raises ParseError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Atom:
    name: str


class Kept:
    """What a worker knows of a function besides its tree. Trees that are kept are shared by sources, so that nobody may change them."""

    __slots__ = ("era", "gathered", "marks", "candidates", "blocks")

    def __init__(self):
        self.era = self.gathered = self.marks = self.candidates = self.blocks = None


@dataclass(eq=False, slots=True)
class Node:
    form: Any
    args: list | None
    line: int = 0
    column: int = 0
    end: int | None = field(default=None)
    kept: Kept | None = field(default=None, repr=False)  # of functions that a worker has parsed before


@dataclass(slots=True)
class Token:
    kind: str
    value: Any
    line: int
    column: int
    space: bool  # white space before it
    stop: int = 0  # where it ends in the text


OPERATORS = sorted(
    "\\\\ <- -> => :: ||| || && &&& == != =~ === !== <= >= |> <<< >>> ~>> <<~ ~> <~ <~> ^^^ ++ -- +++ --- <> .. // ** = | < > + - * / ! ^ & @ . ,".split(),
    key=lambda o: -len(o),
)
LEFT = {
    "<-": 40, "\\\\": 40, "||": 120, "|||": 120, "or": 120, "&&": 130, "&&&": 130, "and": 130,
    "==": 140, "!=": 140, "=~": 140, "===": 140, "!==": 140, "<": 150, ">": 150, "<=": 150, ">=": 150,
    "|>": 160, "<<<": 160, ">>>": 160, "~>>": 160, "<<~": 160, "~>": 160, "<~": 160, "<~>": 160,
    "in": 170, "not in": 170, "^^^": 180, "+": 210, "-": 210, "*": 220, "/": 220, "**": 230,
}
RIGHT = {"when": 50, "::": 60, "|": 70, "=>": 80, "=": 100, "++": 200, "--": 200, "+++": 200, "---": 200, "..": 200, "//": 190, "<>": 200}
UNARY = {"!": 300, "^": 300, "not": 300, "+": 300, "-": 300, "&": 90, "@": 320}
CONTINUES = {o for o in (*LEFT, *RIGHT) if o not in ("+", "-", "not in")}
STOPS = {"end", "else", "rescue", "catch", "after"}
_NAME = re.compile(r"[a-z_ª-￿][A-Za-z0-9_ª-￿]*[!?]?")
_ALIAS = re.compile(r"[A-Z][A-Za-z0-9_]*")
_NUMBER = re.compile(r"0x[0-9A-Fa-f_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?\d+)?)?")
_SPACE = re.compile(r"[ \t\r]+")
_OPERATOR = re.compile("|".join(map(re.escape, OPERATORS)))
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">", "/": "/", "|": "|", '"': '"', "'": "'"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "s": " ", "0": "\0", "e": "\x1b", "b": "\b", "a": "\a", "v": "\v", "f": "\f"}


#: What a token begins with that may go on in the next line, or that looks at it.
_OPEN = re.compile("[\"'~?]")
#: Lines that a worker has seen, with what they hold: (kind, value, column, space, stop) of tokens, and (text, column) of comments.
_LINES: dict[str, tuple[list[tuple], list[tuple]]] = {}
MOST_LINES, LONGEST_LINE = 1 << 15, 200
#: Functions that a worker has parsed, by their first line's number and their text without comments; None if their lines aren't one function.
_FUNCTIONS: dict[tuple[int, str], Node | None] = {}
#: Nodes of them that are kept at most, and lines of one.
MOST_NODES, MOST_FUNCTION_LINES = 1 << 16, 100
_nodes_kept = 0
_FUNCTION = re.compile(r"([ \t]*)defp? [^#]* do$")
#: After what a function begins a statement, if a line ends between them: what neither goes on in the next line nor takes its do block.
_BEFORE_KINDS, _BEFORE_NAMES, _BEFORE_PUNCT = frozenset(("alias", "number", "atom", "string", "function")), frozenset(("do", "end")), frozenset((")", "]", "}"))


def _function(lines: list[str], at: int, line: int) -> tuple[Node, int, list[tuple[str, int, int]]] | None:
    """The function that begins with lines[at], how many lines it has, and its comments; it is parsed once for the same text on the same line.

    It begins with a line that ends in do, and ends with the first one that is an end as far indented. Whether that is right is seen by parsing it alone.
    """
    global _nodes_kept
    if (m := _FUNCTION.match(lines[at])) is None or len(lines[at]) > LONGEST_LINE:
        return None
    try:
        stop = lines.index(f"{m[1]}end", at + 1, at + MOST_FUNCTION_LINES) + 1
    except ValueError:
        return None
    texts, comments = lines[at:stop], []
    whole = "\n".join(texts)
    if "#" in whole:
        for k, x in enumerate(texts):
            if (sign := x.find("#")) >= 0:
                if _OPEN.search(x, 0, sign):
                    return None
                comments.append((x[sign:].rstrip("\r"), line + k, sign + 1))
                texts[k] = x[:sign].rstrip(" \t\r")
        whole = "\n".join(texts)
    key = line, whole
    if key in _FUNCTIONS:
        found = _FUNCTIONS[key]
    else:
        if _OPEN.search(whole) or len(whole) > LONGEST_LINE * MOST_FUNCTION_LINES // 2:
            return None
        try:
            tokens = tokenize(key[1], line, 1, False)[0]
            parser = Parser(tokens)
            found = parser.block(())
            if not (parser.now.kind == "eof" and type(found) is Node and found.form in ("def", "defp") and found.end == line + stop - at - 1):
                found = None
        except (ParseError, IndexError, RecursionError):
            found = None  # is parsed again with what is around it
        if found is not None:
            nodes = [x for x in walk(found) if type(x) is Node]
            if any(x.form == "defmodule" for x in nodes):
                found = None
            else:
                found.kept = Kept()
                _nodes_kept += len(nodes)
        if _nodes_kept > MOST_NODES or len(_FUNCTIONS) > MOST_NODES:
            _FUNCTIONS.clear()
            _nodes_kept = 0 if found is None else len(nodes)
        _FUNCTIONS[key] = found
    return None if found is None else (found, stop - at, comments)


def _line(text: str) -> tuple[list[tuple], list[tuple]] | None:
    """What a line holds, scanned once; None if it must be read with what follows it."""
    found = _LINES.get(text)
    if found is None and (bare := text.lstrip(" \t\r"))[:1] == "#":
        return [], [(bare.rstrip("\r"), len(text) - len(bare) + 1)]
    if found is None and len(text) <= LONGEST_LINE and not _OPEN.search(text):
        tokens, comments = _scan(text, 1, 1, False)
        if len(_LINES) >= MOST_LINES:
            _LINES.clear()
        found = _LINES[text] = [(t.kind, t.value, t.column, t.space, t.stop) for t in tokens], [(c, column) for c, _, column in comments]
    return found


def tokenize(text: str, line: int = 1, column: int = 1, functions: bool = False) -> tuple[list[Token], list[tuple[str, int, int]]]:
    """Tokens, with "nl" between statements, and comments as (text, line, column). functions: one that was parsed before is one token."""
    out, comments = _scan(text, line, column, True, functions)
    # a line that begins with a binary operator goes on with the one before
    kept: list[Token] = []
    for k, t in enumerate(out):
        if t.kind == "nl" and t.value == "\n" and (nxt := out[k + 1]) and (nxt.kind == "op" and nxt.value in CONTINUES or nxt.kind == "name" and nxt.value in ("and", "or", "when", "in")):
            continue
        kept.append(t)
    return kept, comments


def _scan(text: str, line: int, column: int, whole: bool, functions: bool = False) -> tuple[list[Token], list[tuple[str, int, int]]]:
    """tokenize() before lines are joined. whole: a text with its end, of which lines seen before aren't scanned again; else one line."""
    out: list[Token] = []
    comments: list[tuple[str, int, int]] = []
    i, n, start = 0, len(text), 1 - column
    lines_, first = text.split("\n") if functions and column == 1 else None, line

    def add(kind, value, stop, space):
        out.append(Token(kind, value, line, begin - start + 1, space, stop))

    while i < n:
        if whole and i == start:
            stop = text.find("\n", i)
            stop = n if stop < 0 else stop
            if lines_ is not None and _FUNCTION.match(text, i, stop) and _begins(out) and (f := _function(lines_, line - first, line)):
                node, many, inner = f
                comments += inner
                end = i - 1
                for k in range(line - first, line - first + many):
                    end += len(lines_[k]) + 1
                out.append(Token("function", node, line, node.column, True, end))
                i, line = end, line + many - 1
                start = i - len(lines_[line - first])
                if i >= n:
                    break
                continue
            try:
                known = _line(text[i:stop])
            except ParseError:
                known = None  # is raised again with its place
            if known is not None:
                for kind, value, at, space, end in known[0]:
                    out.append(Token(kind, value, line, at, space, i + end))
                for comment, at in known[1]:
                    comments.append((comment, line, at))
                i = stop
                if i >= n:
                    break
        c, begin = text[i], i
        space = i == 0 or text[i - 1] in " \t\n"
        if c == "\n":
            if out and out[-1].kind != "nl":
                out.append(Token("nl", "\n", line, i - start + 1, space, i + 1))
            i, line, start = i + 1, line + 1, i + 1
            continue
        if c in " \t\r":
            i = _SPACE.match(text, i).end()
            continue
        if c in "()[]{},;":
            out.append(Token("nl" if c == ";" else "punct", c, line, i - start + 1, space, i + 1))
            i += 1
            continue
        if c == "#":
            stop = text.find("\n", i)
            stop = n if stop < 0 else stop
            comments.append((text[i:stop].rstrip("\r"), line, i - start + 1))
            i = stop
            continue
        if m := _NAME.match(text, i):
            stop = m.end()
            if stop < n and text[stop] == ":" and text[stop : stop + 2] != "::" and (stop + 1 >= n or text[stop + 1] in " \n\t\r"):
                add("key", m[0], stop + 1, space)
                stop += 1
            else:
                out.append(Token("name", m[0], line, i - start + 1, space, stop))
            i = stop
            continue
        if m := _ALIAS.match(text, i):
            stop = m.end()
            if text[stop : stop + 1] == ":" and text[stop : stop + 2] != "::" and (stop + 1 >= n or text[stop + 1] in " \n\t"):
                add("key", m[0], stop + 1, space)
                stop += 1
            else:
                add("alias", m[0], stop, space)
        elif c in "\"'" and text.startswith(('"""', "'''"), i):
            parts, stop = _quoted(text, i + 3, text[i : i + 3], line, True)
            add("string" if c == '"' else "chars", _dedented(parts), stop, space)
        elif c in "\"'":
            parts, stop = _quoted(text, i + 1, c, line, True)
            if stop < n and text[stop] == ":" and text[stop : stop + 2] != "::" and len(parts) == 1 and isinstance(parts[0], str):
                add("key", parts[0], stop + 1, space)
                stop += 1
            else:
                add("string" if c == '"' else "chars", parts, stop, space)
        elif c == "~" and re.match(r"~(?:[a-z]|[A-Z]+)[\[({<|/\"']", text[i:]):
            name = re.match(r"~([a-zA-Z]+)", text[i:])[1]
            j = i + 1 + len(name)
            mark = text[j : j + 3] if text[j : j + 3] in ('"""', "'''") else text[j]
            parts, stop = _quoted(text, j + len(mark), mark if len(mark) == 3 else _PAIRS.get(mark, mark), line, name.islower())
            while stop < n and text[stop].isalpha():  # modifiers carry no meaning here
                stop += 1
            add("sigil", (name, parts), stop, space)
        elif c == ":" and text[i + 1 : i + 2] == '"':
            parts, stop = _quoted(text, i + 2, '"', line, True)
            add("atom", "".join(p for p in parts if isinstance(p, str)), stop, space)
        elif c == ":" and (m := re.compile(r"[A-Za-z_][A-Za-z0-9_@]*[!?]?|\{\}|%\{\}|<<>>|[+\-*/<>=!&|^~.@%]+|\\\\|\[\]|::").match(text, i + 1)) and (text[i : i + 2] != "::" or text[i : i + 3] == ":::"):
            add("atom", m[0], m.end(), space)
        elif m := _NUMBER.match(text, i):
            raw = m[0].replace("_", "")
            value = int(raw, 0) if raw[:2] in ("0x", "0b", "0o") else float(raw) if "." in raw or "e" in raw.lower() else int(raw)
            add("number", value, m.end(), space)
        elif c == "?" and i + 1 < n:
            stop = i + 3 if text[i + 1] == "\\" else i + 2
            ch = _ESCAPES.get(text[i + 2], text[i + 2]) if text[i + 1] == "\\" and i + 2 < n else text[i + 1]
            add("number", ord(ch), stop, space)
        elif text.startswith("...", i):
            add("name", "...", i + 3, space)
            stop = i + 3
        elif text.startswith(("<<", ">>"), i) and text[i : i + 3] not in ("<<<", ">>>", "<<~"):
            add("punct", text[i : i + 2], i + 2, space)
            stop = i + 2
        elif c == "%":
            add("punct", c, i + 1, space)
            stop = i + 1
        else:
            m = _OPERATOR.match(text, i)
            if m is None:
                raise ParseError(f"line {line}: unexpected {c!r}")
            op = m[0]
            add("punct" if op in (",", ".") else "op", op, i + len(op), space)
            stop = i + len(op)
        stop = out[-1].stop
        if lines := text.count("\n", i, stop):
            line += lines
            start = text.rindex("\n", i, stop) + 1
        i = stop
    if whole:
        out.append(Token("eof", None, line, i - start + 1, True, n))
    return out, comments


def _begins(out: list[Token]) -> bool:
    """Whether a name that comes next begins a statement."""
    if not out:
        return True
    if out[-1].kind != "nl":
        return False
    before = next((t for t in reversed(out) if t.kind != "nl"), None)
    if before is None or before.kind in _BEFORE_KINDS:
        return True
    return before.value in (_BEFORE_NAMES if before.kind == "name" else _BEFORE_PUNCT if before.kind == "punct" else ())


def _quoted(text: str, i: int, close: str, line: int, rich: bool) -> tuple[list, int]:
    """Parts (strings and parsed interpolations) up to the closing mark, and the place behind it."""
    parts: list = []
    buf: list[str] = []
    n = len(text)
    while True:
        if i >= n:
            raise ParseError(f"line {line}: text ends within quotes")
        if text.startswith(close, i):
            break
        c = text[i]
        if c == "\\" and i + 1 < n:
            buf.append(_ESCAPES.get(text[i + 1], text[i + 1]) if rich else text[i : i + 2])
            i += 2
        elif rich and text.startswith("#{", i):
            depth, j = 1, i + 2
            while j < n and depth:
                depth += {"{": 1, "}": -1}.get(text[j], 0)
                j += 1
            if depth:
                raise ParseError(f"line {line}: open interpolation")
            if buf:
                parts.append("".join(buf))
                buf = []
            parts.append(parse(text[i + 2 : j - 1], line))
            i = j
        else:
            buf.append(c)
            i += 1
    if buf or not parts:
        parts.append("".join(buf))
    return parts, i + len(close)


def _dedented(parts: list) -> list:
    if len(parts) == 1 and isinstance(parts[0], str):
        lines = parts[0].split("\n")[1:]
        pad = len(lines[-1]) if lines and not lines[-1].strip() else 0
        return ["\n".join(x[pad:] if not x[:pad].strip() else x for x in lines)]
    return parts


_SIGNS, _LITERALS = frozenset(("punct", "op", "name")), frozenset(("alias", "punct", "atom", "number", "function"))


class Parser:
    def __init__(self, tokens: list[Token]):
        self.t, self.i, self.no_do = tokens, 0, 0

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def take(self, kind: str | None = None, value=None) -> Token:
        t = self.t[self.i]
        if kind and t.kind != kind or value is not None and t.value != value:
            raise ParseError(f"line {t.line}: {value or kind} expected, not {t.value!r}")
        self.i += 1
        return t

    def at(self, *values) -> bool:
        t = self.t[self.i]
        return t.kind in _SIGNS and t.value in values

    def lines(self) -> None:
        while self.t[self.i].kind == "nl":
            self.i += 1

    # blocks

    def block(self, stops) -> Any:
        """Statements up to a stop: one expression, a Node "__block__", or clauses as a list of Nodes "->"."""
        first = self.now
        body, clauses = [], None
        self.lines()
        while not (self.now.kind == "eof" or self.at(*stops)):
            t = self.t[self.i]
            heads = [] if self.at("->") else [self.expression()]
            while self.at(","):
                self.take()
                self.lines()
                heads.append(self.expression())
            if self.at("->"):
                self.take()
                clauses = clauses if clauses is not None else []
                clauses.append(Node("->", [heads, []], t.line, t.column))
                self.lines()
                continue
            if len(heads) != 1:
                raise ParseError(f"line {t.line}: unexpected comma")
            (clauses[-1].args[1] if clauses else body).append(heads[0])
            if not (self.now.kind in ("nl", "eof") or self.at(*stops)):
                raise ParseError(f"line {self.now.line}: unexpected {self.now.value!r}")
            self.lines()
        if clauses is not None:
            for c in clauses:
                c.args[1] = self._joined(c.args[1], c)
            return clauses
        return self._joined(body, first)

    @staticmethod
    def _joined(body: list, at) -> Any:
        return body[0] if len(body) == 1 else Node("__block__", body, at.line, at.column)

    def do_block(self) -> tuple[list, int]:
        """do ... end as a keyword list, and the line of its end."""
        self.take("name", "do")
        saved, self.no_do = self.no_do, 0
        pairs, key = [], "do"
        while True:
            pairs.append(Node("{}", [Atom(key), self.block(STOPS)]))
            t = self.take("name")
            if t.value == "end":
                break
            key = t.value
        self.no_do = saved
        return pairs, t.line

    # expressions

    def expression(self, least: int = 0) -> Any:
        left = self.prefix()
        while True:
            t = self.t[self.i]
            if t.kind != "op" and t.kind != "name":
                return left
            op = t.value if t.kind == "op" or t.kind == "name" and t.value in ("and", "or", "in", "when", "not") else None
            if op == "not":
                nxt = self.t[self.i + 1]
                if not (nxt.kind == "name" and nxt.value == "in"):
                    return left
                op = "not in"
            if op == "->" or op is None or op not in LEFT and op not in RIGHT:
                return left
            power = LEFT.get(op) or RIGHT[op]
            if power < least:
                return left
            self.take()
            if op == "not in":
                self.take()
            self.lines()
            if op == "|" and self.now.kind == "key":  # an update's pairs
                right = self.arguments("}")
            else:
                right = self.expression(power + (op in LEFT))
            if op == "not in":
                left = Node("not", [Node("in", [left, right], t.line, t.column)], t.line, t.column)
            else:
                left = Node(op, [left, right], getattr(left, "line", 0) or t.line, getattr(left, "column", 0) or t.column)

    def prefix(self) -> Any:
        t = self.t[self.i]
        if t.kind in _LITERALS:
            return self.suffixes(self.primary())
        if t.kind == "op" and t.value in UNARY or t.kind == "name" and t.value == "not":
            self.take()
            if t.value == "&" and self.now.kind == "number":
                return self.suffixes(Node("&", [self.take().value], t.line, t.column))
            if t.value == "..":
                return Node("..", [], t.line, t.column)
            if t.value == "@" and self.now.kind == "name":
                return self.suffixes(Node("@", [self.call_or_name()], t.line, t.column))
            inner = self.expression(UNARY[t.value])
            if t.value == "-" and isinstance(inner, int | float) and not isinstance(inner, bool):
                return -inner
            return Node(t.value, [inner], t.line, t.column)
        return self.suffixes(self.primary())

    def primary(self) -> Any:
        t = self.t[self.i]
        if t.kind == "number" or t.kind == "function":
            return self.take().value
        if t.kind in ("string", "chars", "sigil"):
            self.take()
            parts = t.value[1] if t.kind == "sigil" else t.value
            plain = len(parts) == 1 and isinstance(parts[0], str)
            if t.kind == "string":
                return parts[0] if plain else Node("<<>>", parts, t.line, t.column)
            name = "charlist" if t.kind == "chars" else f"sigil_{t.value[0]}"
            return Node(name, parts, t.line, t.column)
        if t.kind == "atom":
            return Atom(self.take().value)
        if t.kind == "alias":
            return self.alias()
        if t.kind == "name":
            if t.value in ("true", "false", "nil"):
                return Atom(self.take().value)
            if t.value == "fn":
                return self.fn()
            if t.value in STOPS or t.value == "do":
                raise ParseError(f"line {t.line}: unexpected {t.value}")
            return self.call_or_name()
        if t.kind == "punct":
            if t.value == "(":
                self.take()
                saved, self.no_do = self.no_do, 0
                inner = self.block((")",))
                self.no_do = saved
                self.take("punct", ")")
                return inner
            if t.value == "[":
                return self.inside("[", "]")
            if t.value == "{":
                return Node("{}", self.inside("{", "}"), t.line, t.column)
            if t.value == "<<":
                return Node("<<>>", self.inside("<<", ">>"), t.line, t.column)
            if t.value == "%":
                self.take()
                if self.at("{"):
                    return Node("%{}", self.inside("{", "}"), t.line, t.column)
                name = self.alias() if self.now.kind == "alias" else self.call_or_name()
                return Node("%", [name, Node("%{}", self.inside("{", "}"), t.line, t.column)], t.line, t.column)
        if t.kind == "op" and t.value == "..":
            self.take()
            return Node("..", [], t.line, t.column)
        raise ParseError(f"line {t.line}: unexpected {t.value!r}")

    def alias(self) -> Node:
        t = self.take("alias")
        parts = [t.value]
        while self.at(".") and self.t[self.i + 1].kind == "alias":
            self.take()
            parts.append(self.take().value)
        return Node("__aliases__", parts, t.line, t.column)

    def fn(self) -> Node:
        t = self.take()
        saved, self.no_do = self.no_do, 0
        clauses = self.block(("end",))
        self.no_do = saved
        end = self.take("name", "end")
        return Node("fn", clauses if isinstance(clauses, list) else [clauses], t.line, t.column, end.line)

    def inside(self, open_: str, close: str) -> list:
        self.take("punct", open_)
        saved, self.no_do = self.no_do, 0
        out = self.arguments(close)
        self.no_do = saved
        self.take("punct", close)
        return out

    def arguments(self, close: str | None) -> list:
        """Comma-separated expressions; trailing key: value pairs become one keyword list, or stay pairs within brackets."""
        out, pairs = [], []
        if close:
            self.lines()
        while not (close and self.at(close)):
            if self.now.kind == "key":
                key = Atom(self.take().value)
                self.lines()
                pairs.append(Node("{}", [key, self.expression()]))
            else:
                if pairs:
                    raise ParseError(f"line {self.now.line}: keywords must come last")
                out.append(self.expression())
            if close:
                self.lines()
            if not self.at(","):
                break
            self.take()
            self.lines()
        if pairs:
            out += pairs if close in ("]", "}") else [pairs]
        return out

    def starts_argument(self) -> bool:
        """Whether a name without brackets has arguments behind it."""
        t = self.t[self.i]
        if not t.space:
            return False
        if t.kind in ("number", "string", "chars", "sigil", "atom", "alias", "key"):
            return True
        if t.kind == "name":
            return t.value not in ("do", "and", "or", "in", "when", "not", *STOPS) or t.value == "not" and not (self.t[self.i + 1].value == "in")
        if t.kind == "punct":
            return t.value in ("[", "{", "%", "<<", "(")
        if t.kind == "op" and t.value in ("!", "^", "@", "&"):
            return True
        return t.kind == "op" and t.value in ("-", "+") and not self.t[self.i + 1].space

    def call_or_name(self) -> Any:
        t = self.take("name")
        return self.called(t.value, t)

    def called(self, form: Any, t: Token) -> Any:
        """A call of form if arguments or a do block follow, else a variable or a call without arguments."""
        args, end = None, None
        if self.at("(") and not self.now.space:
            args = self.inside("(", ")")
        elif t.value not in ("_", "...") and self.starts_argument():
            self.no_do += 1
            args = self.arguments(None)
            self.no_do -= 1
        if self.at("do") and not self.no_do:
            pairs, end = self.do_block()
            args = [*(args or []), pairs]
        if args is None and isinstance(form, Node):
            args = []
        return Node(form, args, t.line, t.column, end)

    def suffixes(self, left: Any) -> Any:
        while True:
            t = self.t[self.i]
            if t.kind != "punct":
                return left
            if self.at("."):
                self.take()
                self.lines()
                if self.at("("):
                    left = Node(Node(".", [left], t.line, t.column), self.inside("(", ")"), t.line, t.column)
                elif self.at("{"):
                    left = Node(Node(".", [left, "{}"], t.line, t.column), self.inside("{", "}"), t.line, t.column)
                elif self.now.kind in ("name", "alias", "string"):
                    name = self.take()
                    value = name.value if isinstance(name.value, str) else "".join(map(str, name.value))
                    line, column = getattr(left, "line", 0) or name.line, getattr(left, "column", 0) or name.column
                    left = self.called(Node(".", [left, value], line, column), Token("name", value, line, column, True))
                elif self.now.kind == "op":
                    op = self.take()
                    left = self.called(Node(".", [left, op.value], op.line, op.column), op)
                else:
                    raise ParseError(f"line {t.line}: unexpected {self.now.value!r} after a dot")
            elif self.at("[") and not t.space:
                left = Node("access", [left, *self.inside("[", "]")], t.line, t.column)
            elif self.at("(") and not t.space and isinstance(left, Node) and left.args is not None:
                left = Node(left, self.inside("(", ")"), t.line, t.column)
            else:
                return left


def parse(source: str, line: int = 1) -> Any:
    """The tree of a source text. Raises ParseError."""
    return parse_with_comments(source, line)[0]


def parse_with_comments(source: str, line: int = 1, functions: bool = False) -> tuple[Any, list[tuple[str, int, int]]]:
    """The tree and the comments. functions: those parsed before are shared with the trees they were in."""
    try:
        tokens, comments = tokenize(source, line, 1, functions)
        parser = Parser(tokens)
        tree = parser.block(())
    except RecursionError:
        raise ParseError("nested too deeply") from None
    if parser.now.kind != "eof":
        raise ParseError(f"line {parser.now.line}: unexpected {parser.now.value!r}")
    return tree, comments


def children(node: Any) -> list:
    """Sub-trees in order; a form that is itself a tree comes first."""
    if isinstance(node, list):
        return node
    if not isinstance(node, Node):
        return []
    head = [node.form] if isinstance(node.form, Node) else []
    return head + [x for x in (node.args or [])]


def walk(node: Any):
    """The tree's nodes, each before those below it."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        if isinstance(x, Node):
            if x.args:
                todo += x.args[::-1]
            if isinstance(x.form, Node):
                todo.append(x.form)
        elif isinstance(x, list):
            todo += x[::-1]


def encode(node: Any) -> Any:
    """A JSON value; decode() gives the tree back."""
    if isinstance(node, Node):
        return {"f": encode(node.form) if isinstance(node.form, Node) else node.form, "a": None if node.args is None else [encode(x) for x in node.args], "m": [node.line, node.column, node.end]}
    if isinstance(node, Atom):
        return {"t": node.name}
    if isinstance(node, list):
        return [encode(x) for x in node]
    return node


def decode(value: Any) -> Any:
    if isinstance(value, dict):
        if "t" in value:
            return Atom(value["t"])
        return Node(decode(value["f"]) if isinstance(value["f"], dict) else value["f"], None if value["a"] is None else [decode(x) for x in value["a"]], *value["m"])
    if isinstance(value, list):
        return [decode(x) for x in value]
    return value
