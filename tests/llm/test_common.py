"""Shared helpers."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from codequarry.llm import common


@pytest.mark.parametrize("chunked", [False, True])
def test_buffers_of_slices_and_nulls(chunked):
    values = ["a", None, "", "ünï", "x" * 10]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["skip", *values, "last"], kind).slice(1, 5)
        data, ends = common.buffers(pa.chunked_array([column]) if chunked else column)
        assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [v or "" for v in values]


def test_words_and_their_hashes():
    pick = random.Random(1)
    texts = ["".join(pick.choice("aB1ü. -\n\t\x0b日") for _ in range(pick.randint(0, 30))) for _ in range(300)] + ["w" * 500 + " " + "w" * 501, "", "end"]
    data, ends = common.buffers(pa.array(texts))
    for table, pattern in ((common.ALNUM, brute.ALNUM_WORD), (common.VISIBLE, brute.VISIBLE_WORD)):
        low = common.LOWER_TABLE[data]
        starts, stops, offsets = common.word_spans(low, ends, table)
        got = [[low[a:b].tobytes().decode() for a, b in zip(starts[i:j], stops[i:j])] for i, j in zip(offsets, offsets[1:])]
        want = [pattern.findall(t.translate(brute.LOWER)) for t in texts]
        assert got == want
        h = common.word_hashes(low, starts, stops)
        flat = [w for r in want for w in r]
        assert len(set(h.tolist())) == len(set(flat)) and len(set(zip(h.tolist(), flat))) == len(set(flat))


def test_steps_hold_so_many_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 10, 50, 1, 1, 1, 0)])], ["t"])
    parts = [p.column("t").to_pylist() for p in common.steps(batch, "t", 20)]
    assert sum(parts, []) == batch.column("t").to_pylist() and max(map(len, parts)) == 4
    assert all(len(p) == 1 or sum(map(len, p)) <= 20 for p in parts)
    assert list(common.steps(batch.slice(0, 0), "t")) == []


def test_mix_is_one_to_one():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(common.mix(x))) == len(x)


def test_a_shared_folder_is_asked_for(spark):
    assert common.shared_dir(spark) == common.shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
