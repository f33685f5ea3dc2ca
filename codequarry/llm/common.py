"""Helpers shared by the operators: shared storage, Arrow text buffers, hashes.

Internal columns start with ``__cq_`` so that extra columns of the input,
whatever their names, never collide with them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy step holds; a longer document goes alone.
STEP_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_cq_shared", None)
    if not found:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = context._cq_shared = "file://" + tempfile.mkdtemp(prefix="codequarry-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there from now on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of keys (two longs or so) that are broadcast at most: some 50 MB.
BROADCAST_ROWS = 500_000


def keys_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows for one side of a join, cut; to be broadcast if there are few, else left to a shuffled join that can be split."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is; the quick way for ASCII strings gives the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one column's value changed and the order of columns kept."""
    return df.select(*[value.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def steps(batch: pa.RecordBatch, text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of batch, of at most so many bytes of text unless one row alone has more."""
    n = batch.num_rows
    if not n:
        return
    _, ends = buffers(batch.column(text))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _words_table(breaks: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(breaks)] = False
    return table


LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32
#: Word bytes after lower-casing: digits, a-z and all of multi-byte characters.
ALNUM = _words_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Word bytes: all but ASCII white space.
VISIBLE = _words_table(b" \t\n\x0b\f\r")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_spans(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for n rows n + 1 offsets into them."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    change = inside[1:] != inside[:-1]
    starts, stops = np.flatnonzero(change & inside[1:]), np.flatnonzero(change & inside[:-1])
    inner = ends[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    split = inner[inside[inner] & inside[inner + 1]]
    if len(split):  # two rows meet inside a run of word bytes
        starts, stops = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([stops, split]))
    return starts, stops, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes."""
    out = np.full(len(starts), 0x84222325CBF29CE4, np.uint64)
    if not len(starts):
        return out
    length = stops - starts
    order = np.argsort(-length, kind="stable")
    at, left = starts[order], length[order]
    h = out[order]
    live = len(order)
    short = -left
    for k in range(int(left[0])):
        live = int(np.searchsorted(short, -k, "left"))  # those longer than k bytes
        if live < 64 and k > 64:
            break
        h[:live] = (h[:live] ^ data[at[:live] + k]) * _BASE
        h[:live] ^= h[:live] >> np.uint64(29)
    else:
        out[order] = h
        return out
    for i in range(live):  # a few very long words
        x = int(h[i])
        for b in data[at[i] + k : at[i] + left[i]].tobytes():
            x = ((x ^ b) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
            x ^= x >> 29
        h[i] = x
    out[order] = h
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
