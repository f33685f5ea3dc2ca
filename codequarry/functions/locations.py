"""Places of literals and regular expressions in a text, as (line, column) from 1; columns count graphemes."""

from __future__ import annotations

import re

import regex


def _places(text: str, starts):
    line, line_start, at = 1, 0, 0
    for s in starts:
        n = text.count("\n", at, s)
        if n:
            line += n
            line_start = text.rindex("\n", at, s) + 1
        at = s
        before = text[line_start:s]
        yield line, 1 + (len(before) if before.isascii() else len(regex.findall(r"\X", before)))


def literal_locations(text: str, literal: str) -> list[tuple[int, int]]:
    """Of each occurrence that doesn't overlap the one before; none of an empty literal."""
    starts, i = [], text.find(literal) if literal else -1
    while i >= 0:
        starts.append(i)
        i = text.find(literal, i + len(literal))
    return list(_places(text, starts))


def regex_locations(text: str, pattern: str) -> list[tuple[int, int]]:
    return list(_places(text, (m.start() for m in re.finditer(pattern, text))))
