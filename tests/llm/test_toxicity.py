"""Toxicity: the kernel by definition, gapped insults, and held-out accuracy."""

import os
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from codequarry.llm import toxicity as tox

_pick = random.Random(0)
CLEAN = ["".join(_pick.choice(("ri", "ver", "sto", "ne", "ma", "lin", "ta", "per", "son", "wa", "el", "bu", "cha", "di")) for _ in range(_pick.randint(1, 4))) for _ in range(3000)]
INSULTS = ["glorbat", "frazzwit", "snorkeldolt"]


def corpus(n=400, seed=1):
    """Texts and labels: invented insults, some of them spelled oddly."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        w = [pick.choice(CLEAN) for _ in range(pick.randint(12, 60))]
        bad = i % 4 == 0
        if bad:
            x = pick.choice(INSULTS)
            if pick.random() < 0.3:
                k = pick.randrange(1, len(x))
                x = x[:k] + pick.choice("-*x") + x[k:]
            w.insert(pick.randrange(len(w)), x)
        rows.append((i, " ".join(w), int(bad)))
    return rows


@pytest.fixture(scope="module")
def machine():
    rows = corpus()
    return tox.fit([t for _, t, y in rows if y], [t for _, t, y in rows if not y])


def test_sequences_are_the_kernels_by_definition():
    for text in ("stone", " dolt ", "a b", "xyz zyx", "s-t-o-n-e wall", "ünïcode", ""):
        data = np.frombuffer(text.encode(), np.uint8)
        s, _ = tox.signs(data, np.array([0, len(data)]))
        want = {}
        for key, w in brute.subsequence_features(s.tolist(), tox.ORDER, tox.GAP, tox.DECAY).items():
            if tox._END not in key:
                want[sum(c * tox._SIGNS**k for k, c in enumerate(reversed(key)))] = w
        got = tox.sequences(text)
        # the first place of a sequence is never the pad's own
        assert {k: pytest.approx(v) for k, v in got.items()} == {k: v for k, v in want.items() if k in got}
        assert all(k in got for k, v in want.items())


def highest_by_definition(text, weight):
    """The highest window sums of one text, none within APART places of a higher one; weight(code): a sequence's number."""
    d = np.frombuffer(text.encode(), np.uint8)
    s, _ = tox.signs(d, np.array([0, len(d)]))
    s = s[len(tox._PAD) - 1 :].tolist()
    at = [0.0] * len(s)
    for i in range(len(s) - tox.ORDER - tox.GAP + 1):
        for spread in tox._SPREADS:
            code = 0
            for k in spread:
                code = code * tox._SIGNS + s[i + k]
            at[i] += tox.DECAY ** (spread[-1] + 1 - tox.ORDER) * weight(code)
    left = {i: sum(at[i : i + tox.WINDOW]) for i in range(len(s) - len(tox._PAD))}
    out = []
    while left and len(out) < tox.TOP:
        best = max(left, key=lambda i: (left[i], -i))
        out.append(left[best])
        left = {i: v for i, v in left.items() if abs(i - best) >= tox.APART}
    return out + [0.0] * (tox.TOP - len(out))


def test_windows_equal_sums_by_definition(machine):
    texts = [t for _, t, _ in corpus(30, 3)] + ["", "a", "no", INSULTS[0] + " " + " ".join(CLEAN[:9]) + " " + INSULTS[1], INSULTS[2]]
    got = machine.windows(*tox.buffers(pa.array(texts)))
    for text, value in zip(texts, got):
        want = highest_by_definition(text, lambda c: float(machine.table[c]))
        assert value[0] == pytest.approx(want[0], abs=1e-6)
        assert value[: tox.TOP].sum() == pytest.approx(sum(want), abs=1e-6)
        assert value[-1] == pytest.approx(np.log(len(text.encode()) + 100))


def test_the_querys_scores_equal_the_kernel_machine_by_definition(spark, tmp_path):
    rows = corpus(240, 6)
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in tox.query(spark, str(tmp_path)).collect()}
    seen = [(t, y) for i, t, y in sorted(rows) if zlib.crc32(str(i).encode()) % 5]
    m = tox.fit([t for t, y in seen if y], [t for t, y in seen if not y])
    features = [tox.sequences(x) for x in m.landmarks]
    norms = [sum(v * v for v in f.values()) ** 0.5 for f in features]
    total = {}
    for f, n, c in zip(features, norms, m.coefficients.tolist()):  # the sum over landmarks of coefficient times normalised kernel
        for u, v in f.items():
            total[u] = total.get(u, 0.0) + c * v / n
    for i, t, _ in rows[:40]:
        x = [*highest_by_definition(t, lambda c: round(total.get(c, 0.0) * tox.EXACT) / tox.EXACT), np.log(len(t.encode()) + 100)]
        p = 1 / (1 + np.exp(-(np.dot(x, m.slopes) + m.offset)))
        assert got[i]["score"] == pytest.approx(p, abs=1e-3), i
    assert sum(got[i]["predicted"] == y for i, _, y in rows) >= 0.95 * len(rows)


def test_texts_of_several_pieces(machine, monkeypatch):
    filler = " ".join(CLEAN)
    texts = [filler * 3 + f" {INSULTS[0]} " + filler, "", "x" * 30_000, INSULTS[1], "ж" * 9_000 + f" {INSULTS[2]} and {INSULTS[1]}"]
    whole = machine.windows(*tox.buffers(pa.array(texts)))
    monkeypatch.setattr(tox, "STEP", 8192)
    cuts, rows = tox._pieces(*tox.buffers(pa.array(texts)))
    assert max(np.diff(cuts)) <= 8192 and (np.diff(rows) >= 0).all() and len(rows) > 10
    parts = machine.windows(*tox.buffers(pa.array(texts)))
    assert np.allclose(whole[:, [0, -1]], parts[:, [0, -1]], atol=1e-3)
    data = tox.buffers(pa.array(texts))[0]
    for c in cuts[1:-1]:
        assert data[c] & 0xC0 != 0x80


def test_gapped_and_inserted_signs(machine):
    p = lambda t: float(machine.probability(machine.windows(*tox.buffers(pa.array([t]))))[0])
    for x in INSULTS:
        for said in (x, x.upper(), x[:3] + "-" + x[3:], x[:4] + "z" + x[4:], x[:2] + "." + x[2:], " ".join(x)):
            assert p(f"river wall {said} stone and the water") >= 0.5, said
    for t in ("", " ".join(CLEAN[:200]), "x" * 5000, "1234 5678"):
        assert p(t) < 0.5, t


def test_score_does_not_depend_on_neighbours(machine):
    texts = [t for _, t, _ in corpus(50, 4)]
    together = machine.windows(*tox.buffers(pa.array(texts)))
    alone = np.concatenate([machine.windows(*tox.buffers(pa.array([t]))) for t in texts])
    assert np.array_equal(together, alone)


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(None, None, None, None), (3, "", "x", 1.0), (3, "", "x", 1.0)], "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (8, None), (9, 0), (9, 0)], "doc_id long, toxic int")
    out = tox.score(docs, tox.learn(docs, labels)).collect()
    assert len(out) == len(rows) + 3
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] != 3]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert tox.score(docs.limit(0), tox.learn(docs, labels)).count() == 0
    assert {r["predicted"] for r in tox.score(docs, tox.learn(docs, labels.limit(0))).collect()} == {0}


def test_held_out_labels_are_never_learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a, b = (spark.createDataFrame([(i, 1 - y if flip and held(i) else y) for i, _, y in rows], "doc_id long, toxic int") for flip in (False, True))
    assert np.array_equal(tox.learn(docs, a).table, tox.learn(docs, b).table)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the given tables")
def test_held_out_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in tox.query(spark, sf).where("held_out").collect() if labels.get(r["doc_id"]) is not None]
    bad, good = [s for y, s, _ in got if y], [s for y, s, _ in got if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    # stems of insults occur by chance in clean texts of this table, so it is harder than most
    assert len(bad) > 20 and auc >= 0.9
    assert sum(y == p for y, _, p in got) >= 0.95 * len(got)


def test_letters_of_other_scripts_are_read():
    read = lambda t: tox.signs(*tox.buffers(pa.array([t])))[0].tolist()
    assert read("żółć čeština İğdır") == read("zółć cestina igdır") and read("e\u0301te\u0301 …") == read("été …")
    assert read("СТОП … мир") == read("стоп … мир") and 0 not in read("стоп")[len(tox._PAD) : -len(tox._PAD)]


def test_insults_in_another_script_are_learned():
    other = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ")
    rows = [(t.translate(other), y) for _, t, y in corpus()]
    m = tox.fit([t for t, y in rows if y], [t for t, y in rows if not y])
    held = [(t.translate(other), y) for _, t, y in corpus(200, 9)]
    p = m.probability(m.windows(*tox.buffers(pa.array([t for t, _ in held])))) >= 0.5
    y = np.array([y for _, y in held], bool)
    assert p[y].mean() >= 0.9 and p[~y].mean() <= 0.05
