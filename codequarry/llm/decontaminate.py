"""Benchmark decontamination by suffix arrays over the training texts.

Each task takes the texts of its rows a few megabytes at a time: a shard. It ranks
the shard's suffixes by their first 1, 2, 4, 8 and 13 words, each time by sorting pairs of
ranks, and binary-searches every suffix of every benchmark item in these orders. A
suffix of an item that is found at 13 words is a contaminating window, and
neighbouring windows of one item join into the longest verbatim match. A match
never runs across documents, so no shard needs to see another.

The benchmark is brought and broadcast one block of a checked size at a time. After each block but the last the rows with
what was found are written to the shared folder and the block is freed, so no worker
and no driver holds more than one. Texts are never shuffled.
Words are compared as 64-bit hashes: a window of 13 words can be wrong only if words
collide at one place of it and all others are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import ALNUM, LOWER_TABLE, buffers, cut, read, steps, word_hashes, word_spans
from codequarry.ship import map_arrow

WINDOW = 13
#: Bytes of benchmark text held at once.
BLOCK_BYTES = 8 << 20
_ORDERS = (1, 2, 4, 8)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, end to end, and the rows' offsets into them."""
    data, ends = buffers(texts)
    data = LOWER_TABLE[data]
    starts, stops, offsets = word_spans(data, ends, ALNUM)
    return word_hashes(data, starts, stops), offsets


@dataclass
class Tests:
    """The items of one block: word hashes, each word's distance to its item's end, and the windows' places."""

    words: np.ndarray
    left: np.ndarray
    item: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    names: list[str]
    #: Each item's first word.
    first: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> Tests:
        words, offsets = hashed_words(pa.array([t for _, t in rows], pa.string()))
        size = np.diff(offsets)
        item = np.repeat(np.arange(len(rows)), size)
        left = np.repeat(offsets[1:], size) - np.arange(len(words))
        whole = np.minimum(size, window)[item]  # length of the item's windows
        starts = np.flatnonzero(left >= whole)
        return cls(words, left, item[starts], starts, whole[starts], ["null" if i is None else str(i) for i, _ in rows], offsets[:-1])


def _ranked(key: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of key, the order that sorts it, the distinct keys' first places in that order, and the ranks of asked (-1: absent)."""
    order = np.argsort(key)
    by = key[order]
    new = np.ones(len(by), bool)
    new[1:] = by[1:] != by[:-1]
    firsts = np.flatnonzero(new)
    ranks = np.empty(len(by), np.int64)
    ranks[order] = np.cumsum(new) - 1
    distinct = by[firsts]
    at = np.minimum(np.searchsorted(distinct, asked), len(distinct) - 1)
    return ranks, order, firsts, np.where(distinct[at] == asked, at, -1)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)


def find(words: np.ndarray, offsets: np.ndarray, tests: Tests, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places in words and windows of tests that are verbatim equal there: two arrays side by side."""
    if not len(words) or not len(tests.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, size = len(words), np.diff(offsets)
    left = np.repeat(offsets[1:], size) - np.arange(n)  # words to the document's end

    def shifted(ranks, reach, by):
        """Ranks of the suffixes by words later, 0 beyond the end; ranks count from 1 then."""
        out = np.zeros(len(ranks), np.int64)
        if by < len(ranks):
            out[:-by] = np.where(reach[:-by] > by, ranks[by:] + 1, 0)
        return out

    def paired(train, test, by):
        """Keys of suffixes by two overlapping ranks; a test that has none keeps -1."""
        m = np.int64(n + 2)
        key = (train + 1) * m + shifted(train, left, by)
        later = np.full(len(test), 0, np.int64)
        if by < len(test):
            later[:-by] = np.where(tests.left[:-by] > by, np.where(test[by:] < 0, m, test[by:] + 1), 0)
        return key, np.where((test < 0) | (later == m), -1, (test + 1) * m + later)

    where: list[np.ndarray] = []
    which: list[np.ndarray] = []

    def take(order, firsts, asked, windows, good=None):
        """Adds the places of asked ranks, one for each of windows."""
        ends = np.append(firsts[1:], n)
        hit = asked >= 0
        windows, asked = windows[hit], asked[hit]
        if not len(windows):
            return
        count = ends[asked] - firsts[asked]
        at = order[_runs(firsts[asked], count)]
        w = np.repeat(windows, count)
        if good is not None:
            ok = good(at, w)
            at, w = at[ok], w[ok]
        where.append(at)
        which.append(w)

    # ranks by 1, 2, 4, 8 words; items shorter than the window are looked up on the way
    train, test = words, tests.words
    for k in _ORDERS:
        key, asked = (train, test) if k == 1 else paired(train, test, k // 2)
        train, order, firsts, test = _ranked(key, asked)
        for length in range(k, min(2 * k, window)):
            ws = np.flatnonzero(tests.lengths == length)
            if len(ws):
                begin, by = tests.starts[ws], length - k
                need = test[np.minimum(tests.starts + by, len(test) - 1)] if by else None  # asked for windows of this length only

                def rest(at, w, length=length, by=by, train=train, need=need):
                    fits = left[at] >= length
                    if by:
                        fits &= train[np.minimum(at + by, n - 1)] == need[w]
                    return fits

                take(order, firsts, test[begin], ws, rest)
        if not (test >= 0).any():
            break
    else:
        ws = np.flatnonzero(tests.lengths == window)
        if len(ws):
            key, asked = paired(train, test, window - 8)
            # suffixes that no 8 words of a test begin are not worth their place in the last order
            alive = np.zeros(len(train) + 1, bool)
            alive[test[test >= 0]] = True
            at = np.flatnonzero(alive[train] & (left >= window))
            if len(at):
                _, order, firsts, found = _ranked(key[at], asked[tests.starts[ws]])
                n = len(at)
                take(at[order], firsts, found, ws)
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(where), np.concatenate(which)


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Disjoint ranges, in order, from (n, 2) ranges."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] > reach[:-1]]))
    return np.stack([ranges[new, 0], np.maximum.reduceat(ranges[:, 1], new)], axis=1)


def _blocks(bench: DataFrame, id_col: str, text_col: str) -> Iterator[Tests]:
    """Items of at most about BLOCK_BYTES of text each block; one block at a time is brought to the driver. At least one block."""
    rows = bench.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 8)).first()[0] or 0
    n = max(1, math.ceil(1.2 * total / BLOCK_BYTES))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for b in range(n):
        yield Tests.of([(r["i"], r["t"]) for r in (rows if n == 1 else rows.where(part == b)).collect()])


def _passes(docs: DataFrame, blocks: Iterator[Tests], run) -> DataFrame:
    """docs after run(batches, tests) for each block; written out and the block freed before the next is brought."""
    shared = None
    for tests in blocks:
        if shared is not None:
            docs = cut(docs)
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(tests)
        docs = map_arrow(docs, lambda batches, shared=shared: run(batches, shared.value), docs.schema)
    return docs


def longest(at: np.ndarray, which: np.ndarray, tests: Tests, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, item, place in the document, place in the item and words of each longest match: windows joined along one diagonal."""
    doc, item = np.searchsorted(offsets, at, "right") - 1, tests.item[which]
    place, inner, words = at - offsets[doc], tests.starts[which] - tests.first[item], tests.lengths[which]
    order = np.lexsort((place, place - inner, item, doc))
    doc, item, place, inner, words = doc[order], item[order], place[order], inner[order], words[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(place - inner) != 0) | (np.diff(place) != 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1
    return doc[begin], item[begin], place[begin], inner[begin], (place[end] + words[end] - place[begin] if len(begin) else place)


_FOUND = {"__cq_words": "long", "__cq_ranges": "array<long>", "__cq_items": "array<string>", "__cq_most": "long", "__cq_at": "long", "__cq_item": "string", "__cq_item_at": "long"}


def with_hits(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of docs with what was found in text_col.

    __cq_words: number of words; __cq_ranges: hit words as begin, end, begin, end, ...; __cq_items: ids as strings; __cq_most, __cq_at,
    __cq_item and __cq_item_at: words of the longest match, where it begins in the document, its item and where it begins
    there. Of equally long ones the first in the document counts, then the least item as string, then the first
    in the item. Without a hit __cq_most is 0 and the other three are null.
    """
    empty = {"__cq_words": F.lit(0), "__cq_ranges": F.array(), "__cq_items": F.array(), "__cq_most": F.lit(0)}
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[empty.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _FOUND.items()])

    def run(batches, tests):
        for batch in batches:
            for part in steps(batch, text_col):
                words, offsets = hashed_words(part.column(text_col).cast(pa.string()))
                made = {c: part.column(c).to_pylist() for c in _FOUND}
                made["__cq_words"] = np.diff(offsets)
                doc, item, place, inner, many = longest(*find(words, offsets, tests), tests, offsets)
                cuts = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc)) if len(doc) else []
                for i, j in zip(cuts, cuts[1:]):
                    d = int(doc[i])
                    new = np.stack([place[i:j], place[i:j] + many[i:j]], axis=1)
                    old = np.array(made["__cq_ranges"][d], np.int64).reshape(-1, 2)
                    made["__cq_ranges"][d] = _merged(np.concatenate([old, new])).ravel().tolist()
                    made["__cq_items"][d] = sorted({*made["__cq_items"][d], *(tests.names[k] for k in np.unique(item[i:j]))})
                    top = i + np.flatnonzero(many[i:j] == many[i:j].max())
                    best = min((-int(many[k]), int(place[k]), tests.names[item[k]], int(inner[k])) for k in top)
                    if not made["__cq_most"][d] or best < (-made["__cq_most"][d], made["__cq_at"][d], made["__cq_item"][d], made["__cq_item_at"][d]):
                        made["__cq_most"][d], made["__cq_at"][d], made["__cq_item"][d], made["__cq_item_at"][d] = -best[0], *best[1:]
                yield pa.RecordBatch.from_arrays([pa.array(made[c], part.schema.field(c).type) if c in made else part.column(c) for c in part.schema.names], part.schema.names)

    return _passes(out, _blocks(bench, item_col, item_text), run)


def _hit():
    r = F.col("__cq_ranges")
    return F.aggregate(F.transform(r, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def _contaminated(hit, words):
    return (hit > 0) & (20 * hit >= words)


def matches(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All longest verbatim matches: doc_id, item_id, doc_word, item_word, words. Places count from 0.

    Matches of an item are joined windows on one diagonal, so a match of any length is one row. Each block of the benchmark
    is one pass over docs.
    """
    parts, shared = [], None
    for tests in _blocks(bench, item_col, item_text):
        if shared is not None:
            parts[-1] = cut(parts[-1])
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches, shared=shared):
            tests = shared.value
            for batch in batches:
                for part in steps(batch, "__cq_text"):
                    words, offsets = hashed_words(part.column("__cq_text"))
                    doc, item, place, inner, many = longest(*find(words, offsets, tests), tests, offsets)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(doc)), pa.array([tests.names[k] for k in item], pa.string()), *(pa.array(x, pa.int64()) for x in (place, inner, many))],
                        ["doc_id", "item_id", "doc_word", "item_word", "words"],
                    )

        narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("__cq_text"))
        parts.append(map_arrow(narrow, run, "doc_id long, item_id string, doc_word long, item_word long, words long"))
    return reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted strings), contaminated, and the longest match, for each row of docs.

    The longest match is longest_words (0: none), longest_at (its first word in the text, from 0), longest_item and
    longest_item_at. Null and empty texts have no words and are never contaminated. Items without words match
    nothing; items of fewer words than a window are one window. Items with an equal id are one
    item, an id of null reads "null". Repeated rows each give a row. An empty benchmark hits
    nothing; empty docs give no rows.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("__cq_text"))
    found = with_hits(narrow, bench, text_col="__cq_text").withColumn("n_hit", _hit())
    return found.select("doc_id", F.col("__cq_words").alias("n_words"), "n_hit", F.size("__cq_items").cast("long").alias("n_items"),
                        F.array_sort("__cq_items").alias("items"), _contaminated(F.col("n_hit"), F.col("__cq_words")).alias("contaminated"),
                        F.col("__cq_most").alias("longest_words"), F.col("__cq_at").alias("longest_at"), F.col("__cq_item").alias("longest_item"),
                        F.col("__cq_item_at").alias("longest_item_at"))


def unaffected(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of docs, as they are, without a verbatim match of WINDOW words, however long the text around it.

    A match with an item that is shorter than a window counts where the text is contaminated: such an item, a single word say, is found in
    clean texts too.
    """
    found = with_hits(docs, bench, text_col=text_col, item_col=item_col, item_text=item_text)
    return found.where(~((F.col("__cq_most") >= WINDOW) | _contaminated(_hit(), F.col("__cq_words")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, as they are."""
    return unaffected(docs, read(spark, sf_dir, "benchmark"))


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.sha2(F.array_join("items", ","), 256)).withColumnRenamed("items", "items_sha256")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS b, item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT b, item_id, i AS j, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT b, item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
place AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hit AS (SELECT p.r, p.i, p.n, win.b, win.j, win.item_id FROM place p JOIN win ON p.n = win.n AND array_to_string(p.w[p.i:p.i + p.n - 1], ' ') = win.s),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r),
runs AS (
  SELECT r, any_value(item_id)::VARCHAR AS item, min(i) - 1 AS begins, min(j) - 1 AS item_begins, max(i) - min(i) + any_value(n) AS many
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, b, i - j ORDER BY i) AS g FROM hit) GROUP BY r, b, i - j, g
), best AS (SELECT DISTINCT ON (r) * FROM runs ORDER BY r, many DESC, begins, item, item_begins)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(many, 0)::BIGINT AS longest_words, begins::BIGINT AS longest_at, item AS longest_item, item_begins::BIGINT AS longest_item_at
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN best USING (r)
"""
