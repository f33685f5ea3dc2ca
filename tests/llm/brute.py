"""What the operators have to give, by the plainest means; for small inputs only."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)
WHITE = " \t\n\x0b\x0c\r"
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text: str | None) -> int:
    words = VISIBLE_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    runs = [words[i : i + 4] for i in range(len(words) - 3)] or [words]
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows: list[tuple[int, int]], most: int = 4) -> dict[int, int]:
    """Smallest reachable id of each (id, fingerprint)."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(rows):
        for j, y in rows[a + 1 :]:
            if (x ^ y).bit_count() <= most:
                r, s = sorted((find(i), find(j)))
                root[s] = r
    return {i: find(i) for i, _ in rows}


def line_dedup(rows: list[tuple[int, str | None]], least: int = 10) -> list[tuple[int, int, int, str]]:
    """doc_id, n_lines, n_dropped and the kept text of each row."""
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contamination(docs: list[tuple[int, str | None]], bench: list[tuple[int, str | None]], size: int = 13):
    """doc_id, n_words, n_hit, items as strings, contaminated."""
    words = lambda t: ALNUM_WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, t in bench:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    items |= found
        out.append((i, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def subsequence_features(s: list[int], order: int, gap: int, decay: float) -> dict[tuple, float]:
    """Weights of all sequences of order signs, spread over order + gap signs at most, by definition."""
    from itertools import combinations

    out: dict[tuple, float] = defaultdict(float)
    for at in combinations(range(len(s)), order):
        if at[-1] - at[0] < order + gap:
            out[tuple(s[i] for i in at)] += decay ** (at[-1] - at[0] + 1 - order)
    return out
