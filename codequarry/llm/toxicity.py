"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two strings sums, over all sequences of ORDER signs, the product of their weights
in both, where an occurrence that is spread over s signs weighs DECAY ** (s - ORDER); spreads
beyond ORDER + GAP count nothing. So a word with a sign put in or left out still shares
most of its sequences with the word itself.

Landmarks are words that labelled documents mark as toxic. Sentences of labelled documents are mapped to their kernel values with the
landmarks, whitened (Nyström), and a linear SVM is fitted to them. As the kernel has
explicit sequences, the machine's value of a string is a sum of one number a sequence:
scoring a text is a table look-up at each place, for each way to spread ORDER signs, and
a running sum over WINDOW places. A document is judged by its TOP largest windows that lie apart, so
what clean texts hold once by chance weighs less than what is said again and again.

Letters with marks are read as the plain ones. Letters of other scripts share the 26 signs, by their code points, so that
neighbors in an alphabet differ; words are what spaces and other signs divide.

Learning takes at most FIT_ROWS documents a label, by hash of their ids, of at most FIT_BYTES
each. Scoring takes all of every text.
"""

from __future__ import annotations

import itertools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import buffers, read, steps
from codequarry.ship import map_arrow

ORDER, GAP, DECAY, WINDOW, TOP = 4, 2, 0.5, 10, 3
#: Places between two windows of a text at least, so that one long word doesn't count twice.
APART = 2 * WINDOW
#: Bytes of text read at once; a longer text is read in pieces that end at white space.
STEP = 1 << 20
#: Most labelled documents of each label to learn from, and most bytes of one.
FIT_ROWS, FIT_BYTES = 1500, 32_768
LANDMARKS = 40
STRENGTH = 0.4
#: Fewest toxic texts that a mark must be in, and share of them that a lone mark with a sign put in weighs as.
MARKED, VARIED = 5, 0.05
#: Numbers of the table are whole parts of one by this power of two, so sums of them are exact and equal windows tie.
EXACT = 4096
#: What a stem's chi-square counts beside a word's.
STEM = 0.95
_SIGNS, _END = 28, 27
_SPREADS = [(0, *c) for c in itertools.combinations(range(1, ORDER + GAP), ORDER - 1)]
_PAD = np.array([0, *[_END] * (ORDER + GAP), 0], np.uint8)

_CODES = np.zeros(256, np.uint8)
_CODES[97:123] = np.arange(1, 27)
_CODES[65:91] = np.arange(1, 27)
for _digit, _letter in zip("013457@", "oieasta"):
    _CODES[ord(_digit)] = ord(_letter) - 96
#: The second byte of Latin letters with marks, as the plain letter.
_LATIN = np.zeros(256, np.uint8)
for _k, _c in enumerate("aaaaaaaceeeeiiiidnooooo ouuuuy saaaaaaaceeeeiiiidnooooo ouuuuy y"):
    _LATIN[0x80 + _k] = 0 if _c == " " else ord(_c) - 96


#: Signs that part no word if they stand between two letters.
_WITHIN = np.zeros(256, bool)
_WITHIN[list(b".-_*'|~^+=")] = True


def _other_letters() -> np.ndarray:
    """A sign for each code point beyond Latin-1: 0 for no letter, and _MARK for marks, which are left out."""
    out = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x32000)):  # ideographs and Hangul, all of them letters
        out[lo:hi] = 1 + np.arange(lo, hi) % 26
    for lo, hi in ((0x100, 0x3400), (0xA000, 0xAC00), (0xF900, 0xFE00), (0xFE20, 0x20000)):
        for c in range(lo, hi):
            kind = unicodedata.category(chr(c))[0]
            if kind == "M":
                out[c] = _MARK
            elif kind == "L":
                plain = ord(unicodedata.normalize("NFKD", chr(c).lower())[0])
                out[c] = _CODES[plain] if plain < 128 else 1 + plain % 26
    return out


_MARK = 255
_OTHER = _other_letters()


def _read_others(data: np.ndarray, code: np.ndarray, keep: np.ndarray) -> None:
    """Put the signs of letters beyond Latin-1 at their last bytes, and leave their other bytes out."""
    for size, low, high, bits in ((2, 0xC4, 0xE0, 31), (3, 0xE0, 0xF0, 15), (4, 0xF0, 0xF5, 7)):
        lead = np.flatnonzero((data >= low) & (data < high))
        point = data[lead].astype(np.int64) & bits
        for k in range(1, size):
            point = point << 6 | (data[lead + k] & 63)
        sign = _OTHER[point]
        lead, sign = lead[sign > 0], sign[sign > 0]
        for k in range(size - 1):
            keep[lead + k] = False
        keep[lead[sign == _MARK] + size - 1] = False
        code[lead + size - 1] = np.where(sign == _MARK, 0, sign)


def signs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs 0 (no letter) to 26 of each row between pads, and the rows' offsets.

    Single letters with one other sign between each two of them are drawn together, and a sign of _WITHIN between two letters is left out.
    """
    code = _CODES[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    code[lead + 1] = _LATIN[data[lead + 1]]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    _read_others(data, code, keep)
    n, rows = len(data), len(ends) - 1
    if n:
        letter = np.zeros(n + 4, bool)
        letter[2:-2] = code > 0
        before1, before2, after1, after2 = (letter[i : i + n].copy() for i in (1, 0, 3, 4))
        for shifted, edges in ((before1, (ends[:-1],)), (before2, (ends[:-1], ends[:-1] + 1)), (after1, (ends[1:] - 1,)), (after2, (ends[1:] - 1, ends[1:] - 2))):
            for at in edges:  # what lies in another row is no letter of this one
                shifted[at[(at >= 0) & (at < n)]] = False
        inner = ~letter[2:-2] & before1 & after1 & ~before2 & ~after2
        keep &= ~(inner | (_WITHIN[data] & before1 & after1))
    before = np.concatenate([[0], np.cumsum(keep)])
    new = before[ends]
    pad = len(_PAD)
    out = np.empty(int(new[-1]) + pad * (rows + 1), np.uint8)
    at = np.arange(int(new[-1])) + pad * np.repeat(np.arange(1, rows + 1), np.diff(new))
    out[at] = code[keep]
    for k in range(pad):
        out[new + pad * np.arange(rows + 1) + k] = _PAD[k]
    return out, new + pad * np.arange(1, rows + 2)


def _codes_at(s: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """For each spread its weight and the sequence's number at each place but the last few."""
    n = len(s) - (ORDER + GAP - 1)
    if n <= 0:
        return []
    wide = s.astype(np.int32)
    pair = {d: wide[: len(s) - d] * _SIGNS + wide[d:] for d in range(1, ORDER + GAP)}
    upper = {d: pair[d][:n] * (_SIGNS * _SIGNS) for d in pair}
    return [(DECAY ** (c - ORDER + 1), upper[a] + pair[c - b][b : b + n]) for _, a, b, c in _SPREADS if c - b in pair]


def sequences(text: str) -> dict[int, float]:
    """The explicit features of a short string."""
    out: dict[int, float] = {}
    data = np.frombuffer(text.encode(), np.uint8)
    s, _ = signs(data, np.array([0, len(data)]))
    for weight, codes in _codes_at(s):
        for c in codes.tolist():
            if not _has_end(c):
                out[c] = out.get(c, 0.0) + weight
    return out


def _has_end(code: int) -> bool:
    return any(code // _SIGNS**k % _SIGNS == _END for k in range(ORDER))


def _at(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Weight of the sequences that begin at each place."""
    at = np.zeros(len(s), np.float32)
    for weight, codes in _codes_at(s):
        at[: len(codes)] += np.float32(weight) * table[codes]
    return at


def _largest(s: np.ndarray, offsets: np.ndarray, table: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each row's largest windows, none within APART places of a larger one, and where they begin; 0 and -1 for lack of more."""
    total = np.concatenate([[0.0], np.cumsum(_at(s, table), dtype=np.float64)])
    # a row begins at the sign 0 before it and ends at the one before the next row; no window runs past that or begins in a pad
    begins = offsets[:-1] - 1
    stops = np.append(begins[1:], len(s))
    first = np.arange(begins[0], len(s))
    sums = total[np.minimum(first + WINDOW, np.repeat(stops, stops - begins))] - total[first]
    pads = (offsets[1:] - len(_PAD))[:, None] + np.arange(len(_PAD))
    sums[pads[pads < stops[:, None]] - begins[0]] = -np.inf
    starts, ends = begins - begins[0], stops - begins[0]
    value, place = np.zeros((len(begins), top)), np.full((len(begins), top), -1)
    for k in range(top):
        most = np.maximum.reduceat(sums, starts)
        where = np.flatnonzero(sums == np.repeat(most, ends - starts))
        row, one = np.unique(np.searchsorted(starts, where, "right") - 1, return_index=True)
        where = where[one]
        good = np.isfinite(most[row])
        row, where = row[good], where[good]
        value[row, k], place[row, k] = most[row], where + begins[0]
        around = where[:, None] + np.arange(1 - APART, APART)
        sums[np.clip(around, starts[row][:, None], ends[row][:, None] - 1)] = -np.inf
    return value, place


def _chunks(texts: list[str], most: int = STEP):
    """Signs and offsets of consecutive texts, and the first one's number."""
    data, ends = buffers(pa.array(texts, pa.string()))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, *signs(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to


def _pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with texts of over STEP bytes cut at white space, or where a character begins, and each piece's row."""
    cuts, rows = [0], []
    for r in range(len(ends) - 1):
        lo, hi = int(ends[r]), int(ends[r + 1])
        while hi - lo > STEP:
            near = np.flatnonzero(np.isin(data[lo + STEP - 4096 : lo + STEP], (9, 10, 11, 12, 13, 32)))
            if not len(near):
                near = np.flatnonzero((data[lo + STEP - 4096 : lo + STEP] & 0xC0) != 0x80) - 1
            lo += STEP - 4096 + (int(near[-1]) + 1 if len(near) else 4096)
            cuts.append(lo)
            rows.append(r)
        cuts.append(hi)
        rows.append(r)
    return np.array(cuts, np.int64), np.array(rows, np.int64)


@dataclass
class Machine:
    """A number for each sequence, and the logistic curve that turns a document's largest windows into a probability."""

    table: np.ndarray
    slopes: np.ndarray
    offset: float
    landmarks: list[str]
    #: What each landmark's kernel value, divided by the landmark's norm, adds: the same machine as the table.
    coefficients: np.ndarray

    def windows(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each row's TOP largest window sums, 0 where it has none, and the logarithm of its length: the longer a clean text, the larger its largest windows."""
        out = np.full((len(ends) - 1, TOP), -np.inf)
        cuts, rows = _pieces(data, ends)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + STEP, "right")) - 1)
            value, place = _largest(*signs(data[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at]), self.table, TOP)
            value[place < 0] = -np.inf
            own = rows[at:to]
            if len(np.unique(own)) == len(own) and (at == 0 or rows[at - 1] != own[0]):
                out[own] = value
            else:
                for r, v in zip(own.tolist(), value):
                    out[r] = -np.sort(-np.concatenate([out[r], v]))[:TOP]
            at = to
        return np.hstack([np.where(np.isfinite(out), out, 0.0), np.log(np.diff(ends) + 100.0)[:, None]])

    def probability(self, largest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(largest @ self.slopes + self.offset, -30, 30)))


#: Signs as letters; all others part words.
_LETTERS = bytes(96 + c if 0 < c < 27 else 32 for c in range(256))


def _words(text: str) -> set[str]:
    s, _ = signs(*buffers(pa.array([text])))
    return {w for w in s.tobytes().translate(_LETTERS).decode().split() if len(w) >= 3}


def _distinct(texts: list[str]) -> tuple[list[str], list[set[str]]]:
    """Texts without near copies of earlier ones, those sharing half of the eight words with the least hashes, and the words of each."""
    seen: dict[int, list[int]] = {}
    known: dict[str, int] = {}
    out, said = [], []
    for t in texts:
        words = _words(t)
        for w in words:
            if w not in known:
                known[w] = hash_of(w)
        low = sorted([known[w] for w in words])[:8]
        count: dict[int, int] = {}
        for h in low:
            for k in seen.get(h, ()):
                count[k] = count.get(k, 0) + 1
        if max(count.values(), default=0) >= 4:
            continue
        for h in low:
            seen.setdefault(h, []).append(len(out))
        out.append(t)
        said.append(words)
    return out, said


def hash_of(word: str) -> int:
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 31)


def _units(words: set[str]) -> set[str]:
    """Words, closed by a space, and their first 4 to 8 letters; each begins with the space before it."""
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(4, min(len(w), 9))}


def _counted(texts: list[set[str]]) -> dict[str, int]:
    """In how many texts each unit is."""
    out: dict[str, int] = {}
    for words in texts:
        for u in _units(words):
            out[u] = out.get(u, 0) + 1
    return out


def _mined(toxic: list[set[str]], seen: dict[str, int], clean: int) -> list[str]:
    """Words and stems by how far their share of toxic texts is beyond their share of clean ones, none the beginning of another.

    seen: in how many of the clean texts each unit is. One with less than STRENGTH of the strongest one's chi-square is held to be
    chance, such as a wrong label that copies share.
    """
    a, b = max(len(toxic), 1), max(clean, 1)
    rated = []
    for u, n in _counted(toxic).items():
        m = seen.get(u, 0)
        p, q, r = n / a, m / b, (n + m) / (a + b)
        if n >= max(MARKED, 0.02 * a) and p > 8 * q and r < 1:
            closed = 1.0 if u.endswith(" ") else STEM  # a stem has to beat its words clearly
            rated.append((closed * (p - q) ** 2 / (r * (1 - r) * (1 / a + 1 / b)), u))
    rated.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    out: list[str] = []
    for z, u in rated:
        if z >= STRENGTH * rated[0][0] and len(out) < LANDMARKS and not any(u.startswith(x.rstrip()) or x.startswith(u.rstrip()) for x in out):
            out.append(u)
    return out


def fit(toxic: list[str], clean: list[str]) -> Machine:
    """A machine from whole labelled texts. Without toxic texts or landmarks it finds nothing toxic.

    It is fitted twice: the second time the strings of clean texts that came nearest to being
    toxic are landmarks too.
    """
    (toxic, left), (clean, other) = _distinct(toxic), _distinct(clean)
    seen, marks = _counted(other), []
    while len(marks) < LANDMARKS and len(left) >= max(MARKED, 0.02 * len(toxic)):
        # what marks few of the toxic texts, as those of one language, is rated among the texts that have no mark yet
        more = [u for u in _mined(left, seen, len(clean)) if not any(u.startswith(m.rstrip()) or m.startswith(u.rstrip()) for m in marks)]
        if not more:
            break
        marks += more[: LANDMARKS - len(marks)]
        left = [words for words in left if not any(f" {w} ".startswith(m) for w in words for m in marks)]
    if not marks or not clean:
        return Machine(np.zeros(_SIGNS**ORDER, np.float32), np.zeros(TOP + 1), -4.0, [], np.zeros(0))
    machine = _fitted(toxic, clean, marks, [])
    return _fitted(toxic, clean, marks, _nearest(machine, clean))


def _nearest(machine: Machine, clean: list[str]) -> list[str]:
    """The highest windows of clean texts, one a text, as strings without repeats."""
    found = []
    for _, s, offsets in _chunks(clean):
        value, place = _largest(s, offsets, machine.table, 1)
        for v, i in zip(value[:, 0].tolist(), place[:, 0].tolist()):
            if i >= 0:
                found.append((v, "".join(" " if c in (0, _END) else chr(96 + c) for c in s[i : i + WINDOW].tolist())))
    found.sort(key=lambda x: (-x[0], x[1]))
    return list(dict.fromkeys(w for _, w in found if w.strip()))[:LANDMARKS]


def _fitted(toxic: list[str], clean: list[str], marks: list[str], more: list[str]) -> Machine:
    lands = [*marks, *more]
    phi = [sequences(w) for w in lands]
    index = {u: i for i, u in enumerate(sorted({u for p in phi for u in p}))}
    land = np.zeros((len(lands), len(index) + 1))  # the last column is that of all other sequences
    for j, p in enumerate(phi):
        for u, v in p.items():
            land[j, index[u]] = v
    land /= np.maximum(np.linalg.norm(land, axis=1, keepdims=True), 1e-9)
    value, vector = np.linalg.eigh(land @ land.T)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    where = np.full(_SIGNS**ORDER, len(index), np.int32)
    where[list(index)] = np.arange(len(index))
    columns = np.ascontiguousarray(land.T)

    def kernels(texts, table, top=1):
        """Kernel values with the landmarks of each text's largest windows by table, where those have any weight, and their texts' numbers."""
        found, owner = [np.zeros((0, len(lands)))], [np.zeros(0, np.int64)]
        for first, s, offsets in _chunks(texts):
            value, place = _largest(s, offsets, table, top)
            row, k = np.nonzero((place >= 0) & (value > 0))
            if not len(row):
                continue
            at = place[row, k]
            stop = np.append(offsets[1:] - 1, len(s))[row]
            out = np.zeros((len(at), len(lands)))
            for weight, codes in _codes_at(s):
                for i in range(WINDOW):
                    inside = (at + i < len(codes)) & (at + i < stop)
                    u = np.where(inside, where[codes[np.minimum(at + i, len(codes) - 1)]], len(index))
                    hit = np.flatnonzero(u < len(index))
                    out[hit] += weight * columns[u[hit]]
            found.append(out)
            owner.append(first + row)
        return np.concatenate(found), np.concatenate(owner)

    # the window of each sentence with the most weight of marks' sequences
    near = np.zeros(_SIGNS**ORDER, np.float32)
    near[list(index)] = land[: len(marks), :-1].max(axis=0)

    def sentences(texts):
        """Kernel values, and the text of each sentence."""
        said = [(x, k) for k, t in enumerate(texts) for x in _sentences(t) if x]
        found, row = kernels([x for x, _ in said], near)
        return found, np.array([k for _, k in said], np.int64)[row]

    kp, own = sentences(toxic)
    kn, _ = sentences(clean)
    # which sentences of a toxic text are the toxic ones: those near a landmark, else its nearest
    close = kp[:, : len(marks)].max(axis=1) if len(kp) else np.zeros(0)
    positive = close >= 0.7 * np.median([np.linalg.norm([*p.values()]) for p in phi[: len(marks)]])
    for k in set(own.tolist()):
        at = np.flatnonzero(own == k)
        if not positive[at].any():
            positive[at[np.argmax(close[at])]] = True
    hard = np.argsort(-kn[:, : len(marks)].max(axis=1), kind="stable")[:20_000] if len(kn) else np.zeros(0, int)
    # landmarks with a sign put in are toxic sentences too
    varied = [v for w in marks for v in _variants(w)]
    ka, _ = kernels(varied, near)

    def even(n):
        return np.full(n, 1 / max(n, 1))

    positives, negatives = np.concatenate([kp[positive], ka]), kn[hard]
    y = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
    w, _ = _svm(np.concatenate([positives, negatives]) @ root, y, 0.5 * np.concatenate([even(len(positives)), even(len(negatives))]))
    table = np.zeros(_SIGNS**ORDER, np.float32)
    table[list(index)] = np.round(((root @ w) @ land)[:-1] * EXACT) / EXACT
    machine = Machine(table, np.zeros(TOP + 1), 0.0, lands, root @ w)
    machine.slopes, machine.offset = _curve(*(machine.windows(*buffers(pa.array(texts, pa.string()))) for texts in (toxic, varied, clean)))
    return machine


def _variants(word: str) -> list[str]:
    """A word or stem as it is, and with one sign put in between two letters."""
    core = word.strip()
    return [word, *(f" {core[:i]}{c}{core[i:]} " for i in range(1, len(core)) for c in "-xe")]


def _sentences(text: str) -> list[str]:
    return [part for line in text.split("\n") for part in line.replace("! ", ". ").replace("? ", ". ").split(". ")]


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machine by Newton steps; c: what each row weighs."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-9
    for _ in range(40):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xo, co = x[on], c[on]
        grad = keep @ w - 2 * xo.T @ (co * y[on] * slack[on])
        step = np.linalg.solve(keep + 2 * xo.T @ (co[:, None] * xo) + 1e-12 * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def _curve(toxic: np.ndarray, varied: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic fit with softened targets.

    A variant stands alone in a text that is otherwise as the middle one of the clean texts; all of them weigh as much as VARIED of
    the toxic texts.
    """
    if len(clean):
        usual = np.median(clean, axis=0)
        varied = np.hstack([-np.sort(-np.hstack([varied[:, :1], np.tile(usual[:-1], (len(varied), 1))]), axis=1)[:, :TOP], np.full((len(varied), 1), usual[-1])])
    s = np.concatenate([toxic, varied, clean])
    scale = np.maximum(np.abs(s).max(axis=0, initial=0.0), 1e-9)
    n, m = len(toxic), len(clean)
    t = np.concatenate([np.full(n + len(varied), (n + 1) / (n + 2)), np.full(m, 1 / (m + 2))])
    c = np.concatenate([np.ones(n), np.full(len(varied), VARIED * max(n, 1) / max(len(varied), 1)), np.ones(m)]) / (n + m + 1)
    x = np.hstack([s / scale, np.ones((len(s), 1))])
    ridge = np.diag([1e-5] * (TOP + 1) + [1e-7])
    w = np.zeros(TOP + 2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ ((c * p * (1 - p) + 1e-9)[:, None] * x) + ridge, x.T @ (c * (p - t)) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1])


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine from labelled rows that are not held out.

    Rows without an id or a label are left out. A document with both labels counts as toxic.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS) for k in (1, 0)]
    taken = some[0].unionByName(some[1])  # at most 2 * FIT_ROWS rows
    rows = (
        docs.select("doc_id", "text").where((F.octet_length("text") > 0) & (F.octet_length("text") <= FIT_BYTES))
        .join(F.broadcast(taken), "doc_id").groupBy("toxic", "text").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id", "text").limit(4 * FIT_ROWS).collect()
    )
    return fit([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row.

    Null and empty texts score as texts without any sequence. Rows with a null id are not held out.
    Repeated rows each give a row. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in steps(batch, "__cq_text", STEP):
                p = m.probability(m.windows(*buffers(part.column("__cq_text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("__cq_text"))
    return map_arrow(narrow, run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(docs, read(spark, sf_dir, "labels")))
