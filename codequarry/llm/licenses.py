"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts and templates are sets of five-word shingles; a template of fewer words is one shingle of
its whole length, and met by the texts' shingles of that length. A template of S shingles belongs to
a size c of at least 1.25 S; windows of 2 c shingles begin at every c-th shingle, so any
stretch as long as 1.25 templates lies whole in one window. A window that holds 80 % of
a template has a Jaccard similarity of at least 0.8 S / (2 c + 0.2 S) with it, and the number of
bands of one row is chosen so that such a window shares a band with MISSED as the
greatest chance of not doing so. What a band retrieves is verified by exact containment.

Windows that hold no shingle of any template can't collide and get no signature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import ALNUM, LOWER_TABLE, buffers, mix, read, steps, word_hashes, word_spans
from codequarry.llm.license_texts import SHORT_NOTICES, TEXTS
from codequarry.ship import map_arrow

SHINGLE, CONTAINMENT, MISSED = 5, 0.8, 1e-6
_FACTORS = (np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, end to end, and the rows' offsets."""
    data, ends = buffers(texts)
    data = LOWER_TABLE[data]
    starts, stops, words = word_spans(data, ends, ALNUM)
    return mix(word_hashes(data, starts, stops)), words


def _runs(h: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words within a row, end to end, and the rows' offsets."""
    n = np.maximum(np.diff(words) - (size - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(n)])
    if len(h) < size:
        return np.zeros(0, np.uint64), offsets
    m = len(h) - size + 1
    all_ = np.zeros(m, np.uint64)
    for k in range(size):
        all_ += h[k : k + m] * _FACTORS[k]
    at = np.arange(int(offsets[-1])) + np.repeat(words[:-1] - offsets[:-1], n)
    return mix(all_[at]), offsets


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of size words, end to end, and the rows' offsets; a row of n words has n - size + 1 or none."""
    return _runs(*_hashed(texts), size)


def bands_for(least: float, missed: float = MISSED) -> int:
    """Bands of one row so that sets of Jaccard similarity least miss each other with a chance of missed at most."""
    return math.ceil(math.log(missed) / math.log(1 - least))


@dataclass
class Templates:
    names: list[str]
    sets: list[np.ndarray]
    #: size c: numbers of its templates, seeds of the bands, and each template's signature
    sizes: dict[int, tuple[list[int], np.ndarray, np.ndarray]] = field(default_factory=dict)
    known: np.ndarray | None = None
    quick: np.ndarray | None = None

    @classmethod
    def of(cls, texts: dict[str, str]) -> dict[int, Templates]:
        """Templates by the words of their shingles: five, or all of a shorter template's. One without words matches nothing."""
        found: dict[int, dict[str, np.ndarray]] = {}
        for name, text in sorted(texts.items()):
            h, words = _hashed(pa.array([text]))
            if size := min(len(h), SHINGLE):
                found.setdefault(size, {})[name] = np.unique(_runs(h, words, size)[0])
        return {size: cls._built(list(sets), list(sets.values())) for size, sets in found.items()}

    @classmethod
    def _built(cls, names: list[str], sets: list[np.ndarray]) -> Templates:
        out = cls(names, sets)
        by: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            c = 1
            while c < 1.25 * len(s):
                c *= 2
            by.setdefault(c, []).append(i)
        for c, mine in by.items():
            least = min(CONTAINMENT * len(sets[i]) / (2 * c + (1 - CONTAINMENT) * len(sets[i])) for i in mine)
            seeds = mix(np.arange(1, bands_for(least) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
            out.sizes[c] = mine, seeds, np.stack([_signature(sets[i][None, :], seeds)[0] for i in mine])
        out.known = np.unique(np.concatenate(sets))
        out.quick = np.zeros(1 << 16, bool)
        out.quick[(out.known >> np.uint64(48)).astype(np.int64)] = True
        return out


def _signature(rows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), len(seeds)), np.uint64)
    for k, s in enumerate(seeds):
        out[:, k] = mix(rows ^ s).min(axis=1)
    return out


def find(h: np.ndarray, offsets: np.ndarray, t: Templates) -> list[tuple[int, int, float, int]]:
    """(row, template, containment, first shingle of the window) of each verified window."""
    maybe = np.flatnonzero(t.quick[(h >> np.uint64(48)).astype(np.int64)])
    hits = maybe[np.isin(h[maybe], t.known)]
    if not len(hits):
        return []
    row = np.searchsorted(offsets, hits, "right") - 1
    place = hits - offsets[row]
    out = []
    for c, (mine, seeds, signatures) in t.sizes.items():
        windows = np.unique(np.concatenate([np.stack([row, place // c]), np.stack([row, place // c - 1])], axis=1), axis=1)
        windows = windows[:, windows[1] >= 0]
        for lo in range(0, windows.shape[1], 4096):
            r, k = windows[:, lo : lo + 4096]
            begin = offsets[r] + k * c
            stop = np.minimum(begin + 2 * c, offsets[r + 1])
            at = np.minimum(begin[:, None] + np.arange(2 * c), (stop - 1)[:, None])  # short windows repeat their last one
            rows = h[at]
            sig = _signature(rows, seeds)
            for j, i in enumerate(mine):
                for w in np.flatnonzero((sig == signatures[j]).any(axis=1)):
                    share = np.isin(t.sets[i], rows[w]).mean()
                    if share >= CONTAINMENT:
                        out.append((int(r[w]), i, float(share), int(k[w] * c)))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment and word (where the best window begins), a row for each template that a row of docs holds.

    Among windows of one row the greatest containment wins, then the first. Null and empty texts hold none, and texts of
    fewer than five words none but shorter templates. Repeated rows and rows with null ids each give their
    own. Without templates, or with an empty table, there are no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates.of(TEXTS | SHORT_NOTICES if templates is None else templates))

    def run(batches):
        t = shared.value
        for batch in batches:
            for part in steps(batch, "__cq_text"):
                best: dict[tuple[int, str], tuple[float, int]] = {}
                h, words = _hashed(part.column("__cq_text"))
                for size, some in t.items():
                    for r, i, share, at in find(*_runs(h, words, size), some):
                        key = r, some.names[i]
                        old = best.get(key, (0.0, 0))
                        if (share, -at) > (old[0], -old[1]) or key not in best:
                            best[key] = share, at
                ids = part.column("doc_id").to_pylist()
                keys = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r] for r, _ in keys], pa.int64()), pa.array([name for _, name in keys], pa.string()), pa.array([best[k][0] for k in keys], pa.float64()), pa.array([best[k][1] for k in keys], pa.int64())],
                    ["doc_id", "license", "containment", "word"],
                )

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("__cq_text"))
    return map_arrow(narrow, run, "doc_id long, license string, containment double, word long")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).withColumn("containment", F.round("containment", 6))
