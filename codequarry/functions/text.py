"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_tokens(text: Column) -> Column:
    """Identifiers split at case changes and other signs, lower-cased, each once in order of first sight, joined by spaces."""
    names = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*[!?]?"), F.lit(0))
    parts = F.flatten(F.transform(names, lambda n: F.split(F.regexp_replace(F.regexp_replace(n, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " "), " ")))
    return F.array_join(F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.lower(p))), " ")


_IDENTIFIER, _TURN, _SIGNS = re.compile(r"[A-Za-z_][A-Za-z0-9_]*[!?]?"), re.compile(r"([a-z0-9])([A-Z])"), re.compile(r"[^A-Za-z0-9]+")


@lru_cache(1 << 16)
def _split_identifier(name: str) -> list[str]:
    return [p.lower() for p in _SIGNS.sub(" ", _TURN.sub(r"\1 \2", name)).split(" ") if p]


#: Longest line whose words a worker keeps: most lines come again.
LONGEST_LINE = 200


def _parts_of(line: str) -> list[str]:
    return [p for n in _IDENTIFIER.findall(line) for p in _split_identifier(n)]


_parts_kept = lru_cache(1 << 15)(_parts_of)


def identifier_tokens_of(text: str | None) -> str | None:
    """identifier_tokens of one text, in a worker that holds it already."""
    return None if text is None else " ".join(dict.fromkeys(chain.from_iterable([_parts_kept(x) if len(x) <= LONGEST_LINE else _parts_of(x) for x in text.split("\n")])))


def line_slice(source: Column, first: Column, last: Column | None = None) -> Column:
    """Lines first to last, counted from 1; a null last is the end of the text."""
    lines = F.split(source, "\n", -1)
    stop = F.size(lines) if last is None else F.least(F.coalesce(last, F.size(lines)), F.size(lines))
    n = F.greatest(stop - first + 1, F.lit(0))
    return F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), n), "\n")


def snippet(source: Column, line: Column, size: int = 5) -> Column:
    """size lines beginning two before a line."""
    begin = F.greatest(line - 3, F.lit(0)) + 1
    return line_slice(source, begin, begin + size - 1)


def context(source: Column, line: Column, around: int = 2) -> Column:
    return line_slice(source, F.greatest(line - around, F.lit(1)), line + around)


def prefix_ilike(column: Column, prefix: str) -> Column:
    """Begins with prefix, whatever the case; % and _ stand for themselves."""
    return F.lower(column).startswith(prefix.lower())


def icontains(column: Column, text: str) -> Column:
    return F.lower(column).contains(text.lower())


#: What parts the words of the stored postings, in lower case.
WORD_BREAK = r"[^a-z0-9]+"


_WORD = re.compile(r"[a-z0-9]+")


def _words_of(line: str) -> list[str]:
    return _WORD.findall(line.lower())


_words_kept = lru_cache(1 << 15)(_words_of)


def word_counts(text: str | None) -> dict[str, int]:
    """Each word of a text's lower case with how often it is there."""
    return dict(Counter(chain.from_iterable([_words_kept(x) if len(x) <= LONGEST_LINE else _words_of(x) for x in (text or "").split("\n")])))


def inner_words(literal: str) -> list[str]:
    """Words that any text with this literal has whole: those with a sign beside them on both sides. Words at its ends may go on in the text."""
    ascii_lower = "".join(c.lower() if c.isascii() else " " for c in literal)
    parts = re.split(WORD_BREAK, ascii_lower)
    return sorted({w for w in parts[1:-1] if w}) if literal.isascii() else []


def glob_regex(glob: str) -> str:
    """A relative path pattern as a regular expression: * within a segment, ** across them."""
    if not glob or glob.startswith("/") or ".." in glob.split("/"):
        raise ValueError(f"unsafe path pattern: {glob!r}")
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def qualified_name(module: Column, name: Column, arity: Column) -> Column:
    base = F.when(module.isNotNull(), F.concat(module, F.lit("."), name)).otherwise(name)
    return F.when(arity.isNotNull(), F.concat(base, F.lit("/"), arity.cast("string"))).otherwise(base)


def version_key(version: Column) -> Column:
    """A sortable struct: parseable versions above others, releases above their pre-releases."""
    r = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
    part = lambda i: F.regexp_extract(version, r, i)
    good = version.rlike(r)
    number = lambda i: F.when(good, F.lpad(part(i), 12, "0")).otherwise(F.lit(""))
    pre = part(4)
    ids = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 12, "0"))).otherwise(F.concat(F.lit("1"), x)))
    return F.struct(good.cast("int").alias("parsed"), number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"),
                    (pre == "").cast("int").alias("release"), F.array_join(ids, ".").alias("pre"), version.alias("text"))


def char_trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's characters."""
    c = F.split(F.lower(text), "")
    n = F.greatest(F.size(c) - 2, F.lit(0))
    join = lambda x, y: F.concat(x, y)
    return F.array_distinct(F.zip_with(F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), join), F.slice(c, 3, n), join))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
