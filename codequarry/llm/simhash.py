"""SimHash near-dedup with a pigeonring filter.

The 64 bits of a fingerprint lie on a ring of five segments. If two fingerprints
differ in at most 4 bits, then from some segment on every chain of the next
1, 2, ... segments differs in at most 4/5 of a bit a segment, rounded down: 0, 1, 2,
3, 4. The first two segments of such a chain make a key: the first must be equal and
the second may differ in one bit. A fingerprint is stored under its five keys and
under those with one set bit of the second segment cleared: of two keys that differ in one bit, the one
without it is where both meet. Keys that only neighbours use are passed over, and
for pairs within a key the longer chains are tested before the full distance.

Only distinct fingerprints are compared. Within a key, a search outward from one
member to the unreached ones returns a spanning forest, never all pairs; a key with
more than BLOCK fingerprints is dealt out as pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import buffers, cut, keys_side, read, steps
from codequarry.llm.components import connected_components
from codequarry.ship import map_arrow

SHINGLE = 4
DISTANCE = 4
SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
#: Most fingerprints compared with each other at once.
BLOCK = 1024


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints. No word: 0. Bit i is bit i of the hashes' majority."""
    data, ends = buffers(texts)
    raw = data.tobytes().lower()
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    count = np.zeros(len(ends) - 1, np.int64)
    for r in range(len(ends) - 1):
        words = raw[ends[r] : ends[r + 1]].split()
        n = len(words)
        if not n:
            continue
        text = b" ".join(words)
        if n <= size:
            hashes.append(digest(text, SEED))
            count[r] = 1
            continue
        at = [0]
        for w in words:
            at.append(at[-1] + len(w) + 1)
        hashes += [digest(text[i : j - 1], SEED) for i, j in zip(at, at[size:])]
        count[r] = n - size + 1
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    h = np.array(hashes, np.uint64)
    stops = np.cumsum(count[full])
    begins = stops - count[full]
    ones = np.zeros((len(full), 64), np.int64)
    # rows are summed a step of hashes at a time, so that the unpacked bits stay small
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(stops, begins[i] + 65536, "right")))
        for lo in range(int(begins[i]), int(stops[j - 1]), 1 << 20):  # one very long text may need several
            hi = min(int(stops[j - 1]), lo + (1 << 20))
            bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if j == i + 1:
                ones[i] += bits.sum(axis=0, dtype=np.int64)
            else:
                ones[i:j] += np.add.reduceat(bits, begins[i:j] - begins[i], axis=0, dtype=np.int32)
        i = j
    set_ = ones * 2 > count[full][:, None]
    out[full] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__cq_text"):
                fp = fingerprints(part.column("__cq_text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("__cq_text"))
    return map_arrow(narrow, run, "doc_id long, fp long")


def _own_keys() -> list:
    """The five keys of a column fp: the segment's number, the segment, and the one after it."""
    out = []
    for i in range(5):
        j = (i + 1) % 5
        one = F.shiftrightunsigned("fp", STARTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))
        two = F.shiftrightunsigned("fp", STARTS[j]).bitwiseAND(F.lit((1 << WIDTHS[j]) - 1))
        out.append(F.lit(i << 26).bitwiseOR(F.shiftleft(one, 13)).bitwiseOR(two).cast("long"))
    return out


def _beside(key, width: int = 13) -> list:
    """A key, and for each bit of the second segment the key without it, or null if it isn't set."""
    bits = [F.lit(1 << b).cast("long") for b in range(width)]
    return [key, *(F.when(key.bitwiseAND(b) != 0, key.bitwiseXOR(b)) for b in bits)]


def _ring_rows(classes: DataFrame) -> DataFrame:
    """key, fp: each fingerprint under its own five keys and those with a bit less in the second segment."""
    keys = [k for i, own in enumerate(_own_keys()) for k in _beside(own, WIDTHS[(i + 1) % 5])]
    return classes.select("fp", F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")


def _large_keys(classes: DataFrame) -> DataFrame:
    """key, n: all keys that may have more than BLOCK rows, and no less than what they have.

    A key's rows are those that own it or one of the 13 with a bit more, so one of the 14 is owned by more than a
    fourteenth of BLOCK. Only owned keys are counted, five for a fingerprint.
    """
    owned = classes.select(F.explode(F.array(*_own_keys())).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 14)
    return owned.select(F.explode(F.array(*_beside(F.col("key")))).alias("key"), "n").where("key IS NOT NULL").groupBy("key").agg((F.sum("n") + BLOCK).alias("n"))


def _own_key(fp: np.ndarray, i: np.ndarray) -> np.ndarray:
    starts, widths = np.array(STARTS, np.uint64), np.array(WIDTHS, np.uint64)
    j = (i + 1) % 5
    one = (fp >> starts[i]) & ((np.uint64(1) << widths[i]) - np.uint64(1))
    two = (fp >> starts[j]) & ((np.uint64(1) << widths[j]) - np.uint64(1))
    return (i.astype(np.uint64) << np.uint64(26)) | (one << np.uint64(13)) | two


def _near(x: np.ndarray, start: int) -> np.ndarray:
    """Which differences pass each longer chain from start on, and at last the full distance."""
    alive = np.arange(len(x))
    mask = 0
    for n in range(5):
        k = (start + n) % 5
        mask |= ((1 << WIDTHS[k]) - 1) << STARTS[k]
        if n:  # the first segment is equal by the key
            alive = alive[np.bitwise_count(x[alive] & np.uint64(mask)) <= n * DISTANCE // 4]
    return alive


def _edges_within(fp: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that the chain filter passes, as (smallest, member)."""
    left, out = np.arange(len(fp)), []
    signed = fp.view(np.int64)
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        group = [todo[0]]
        while todo and len(left):
            hit = _near(fp[left] ^ fp[todo.pop()], start)
            if len(hit):
                new = left[hit]
                todo += list(new)
                group += list(new)
                left = np.delete(left, hit)
        if len(group) > 1:
            ids = signed[group]
            low = int(ids.min())
            out += [(low, int(v)) for v in ids if v != low]
    return out


def _link_rows(batches):
    """Edges of each run of rows with one key and part; runs may cross batches."""
    rest = np.zeros((3, 0), np.int64)

    def edges(key, part, fp):
        if not len(key):
            return np.zeros((2, 0), np.int64)
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        size = np.diff(np.append(new, len(key)))
        seg, u = (key >> 26).astype(np.int64), fp.view(np.uint64)
        member = _own_key(u, seg).view(np.int64) == key
        has = np.add.reduceat(member, new) > 0
        found = []
        two = new[has & (size == 2)]
        if len(two):
            x = u[two] ^ u[two + 1]
            for s in range(5):
                at = two[seg[two] == s]
                ok = at[_near(u[at] ^ u[at + 1], s)] if len(at) else at
                found.append(np.stack([fp[ok], fp[ok + 1]]))
            del x
        many = []
        for i, n in zip(new[has & (size > 2)], size[has & (size > 2)]):
            many += _edges_within(u[i : i + n], int(seg[i]))
        if many:
            found.append(np.array(many, np.int64).T)
        e = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return np.unique(np.stack([e.min(axis=0), e.max(axis=0)]), axis=1) if e.shape[1] else e

    def batch_of(e):
        return pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["a", "b"])

    for b in batches:
        rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "part", "fp")])
        rows = np.concatenate([rest, rows], axis=1)
        if not rows.shape[1]:
            continue
        last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
        cut_at = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
        yield batch_of(edges(rows[0, :cut_at], rows[1, :cut_at], np.ascontiguousarray(rows[2, :cut_at])))
        rest = rows[:, cut_at:]
    yield batch_of(edges(rest[0], rest[1], np.ascontiguousarray(rest[2])))


def links(classes: DataFrame) -> DataFrame:
    """Edges a, b between distinct fingerprints that connect all that DISTANCE bits connect; some of them only."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes become many rows: they are dealt out evenly before that
    rows = _ring_rows(classes.select("fp").repartition(n, "fp"))
    tagged = rows.join(keys_side(_large_keys(classes)), "key", "left")
    blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(3)), blocks).cast("int")
    # a block meets each other block, and itself, in a part of its own
    parts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.least(own, o) * blocks + F.greatest(own, o))
    dealt = tagged.select("key", "fp", F.explode(parts).alias("part"))
    dealt = dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part")
    return map_arrow(dealt.select("key", F.col("part").cast("long").alias("part"), "fp"), _link_rows, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable, for each row.

    Null and empty texts and texts of white space only have fingerprint 0 and are linked like
    any other. Texts of fewer than 4 words are one shingle. Rows with a null id take part and
    get their component's smallest id, null if it has none. Repeated rows each
    give a row. An empty table gives none.
    """
    prints = cut(with_fingerprint(docs, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(classes))
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # both cut, so that a large component and a fingerprint of very many copies can be split between tasks
    least = cut(labelled.groupBy("root").agg(F.min("first").alias("component_id")))
    ids = cut(labelled.join(least, "root").select("fp", "component_id"))
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id.

    Only the ids that go meet the texts. An id that stays by one of its rows stays by all; rows
    without an id can't be named and stay.
    """
    found = near_duplicates(docs).where("doc_id IS NOT NULL")
    gone = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays").select(F.col("doc_id").alias("__cq_gone"))
    gone = keys_side(gone)
    return docs.join(gone, F.col("doc_id") == F.col("__cq_gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
