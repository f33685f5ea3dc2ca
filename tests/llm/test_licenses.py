"""License scans against exact containment in every window."""

import random

import brute
import pytest

from codequarry.llm import licenses

SCHEMA = "doc_id long, text string"
FILL = [f"f{i}" for i in range(300)]


def plain(rows, templates):
    """(doc, license, containment, word) by exact containment of all windows, without any hashing."""
    words = lambda t: brute.ALNUM_WORD.findall((t or "").translate(brute.LOWER))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = []
    for doc, t in rows:
        g = grams(words(t))
        for name, text in templates.items():
            s = set(grams(words(text)))
            if not s or not g:
                continue
            c = 1
            while c < 1.25 * len(s):
                c *= 2
            best = max((len(s & set(g[k : k + 2 * c])) / len(s), -k) for k in range(0, len(g), c))
            if best[0] >= licenses.CONTAINMENT:
                out.append((doc, name, round(best[0], 6), -best[1]))
    return sorted(out, key=str)


def fixture(n=150):
    pick = random.Random(6)
    names = list(licenses.TEXTS)
    rows = []
    for i in range(n):
        w = [pick.choice(FILL) for _ in range(pick.randint(0, 300))]
        for _ in range(pick.randint(0, 2)):
            t = licenses.TEXTS[pick.choice(names)].split()
            for _ in range(pick.randint(0, max(1, len(t) // 25))):
                t[pick.randrange(len(t))] = pick.choice(FILL)
            k = pick.randint(0, len(w))
            w[k:k] = t if pick.random() < 0.8 else t[: len(t) // 2]
        rows.append((i, " ".join(w)))
    return rows


def test_finds_all_that_exact_containment_finds(spark):
    rows = fixture()
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    got = sorted(((r["doc_id"], r["license"], round(r["containment"], 6), r["word"]) for r in got), key=str)
    want = plain(rows, licenses.TEXTS)
    assert got == want and len(want) > 80


@pytest.mark.parametrize("least", [0.05, 0.2, 0.5, 0.8])
def test_bands_keep_their_promise(least):
    b = licenses.bands_for(least)
    assert (1 - least) ** b <= licenses.MISSED < (1 - least) ** (b - 1)


def test_deep_in_a_very_long_text(spark):
    text = " ".join(FILL) * 200
    whole = licenses.TEXTS["mit"]
    rows = [(1, text + " " + whole + " " + text), (2, text), (3, whole.upper().replace(",", " ;\n * "))]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, "mit"), (3, "mit")}


def test_nulls_repeats_empty_tables_and_other_templates(spark):
    rows = [(None, "Released under the MIT License."), (2, "released UNDER the mit license"), (2, "released UNDER the mit license"), (3, None), (4, ""), (5, "mit license")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", license string")
    assert sorted(((r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()), key=str) == sorted([(None, "mit-notice"), (2, "mit-notice"), (2, "mit-notice")], key=str)
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, {}).count() == 0 and licenses.scan(docs, {"short": "two words"}).count() == 0
    assert [r["license"] for r in licenses.scan(docs, {"own": "mit license of our own making"}).collect()] == []


def test_notices_of_fewer_than_five_words(spark):
    far = " ".join(FILL)
    rows = [(1, "All rights reserved."), (2, f"{far}. ALL RIGHTS\nRESERVED! {far}"), (3, "all rights are reserved"), (4, "rights reserved"), (5, "all rights"), (6, "reserved all"), (7, "rights reserved. All rights reserved. Released under the MIT License.")]
    found = [(r["doc_id"], r["license"], r["containment"], r["word"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()]
    notice = "all-rights-reserved-notice"
    assert sorted(found) == [(1, notice, 1.0, 0), (2, notice, 1.0, 298), (7, notice, 1.0, 0), (7, "mit-notice", 1.0, 2)]
    own = licenses.scan(spark.createDataFrame(rows, SCHEMA), {"two": "rights reserved", "one": "Are", "none": "..."})
    assert sorted((r["doc_id"], r["license"]) for r in own.collect()) == [(1, "two"), (2, "two"), (3, "one"), (4, "two"), (7, "two")]


def test_recall_of_planted_near_copies(spark):
    pick = random.Random(11)
    rows, planted = [], {}
    for name, text in licenses.TEXTS.items():
        t = text.split()
        for k in range(20):
            near = list(t)
            for _ in range(len(t) // 60 if k else 0):  # a changed word costs five shingles
                near[pick.randrange(len(near))] = pick.choice(FILL)
            a, b = ([pick.choice(FILL) for _ in range(pick.randint(0, 400))] for _ in range(2))
            planted[len(rows)] = name
            rows.append((len(rows), " ".join(a + near + b)))
    rows += [(10_000 + k, " ".join(pick.choice(FILL) for _ in range(500))) for k in range(100)]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    held = {(i, n) for i, n, _, _ in plain(rows, {n: licenses.TEXTS[n] for n in set(planted.values())})}
    recall = len(got & {(i, n) for i, n in planted.items() if (i, n) in held}) / sum((i, n) in held for i, n in planted.items())
    print(f"{len(rows)} documents, {len(held)} pairs by exact containment, recall of planted ones {recall:.4f}")
    assert recall == 1.0 and got == held | {(i, n) for i, n in got if n == "all-rights-reserved-notice"} and all(i < 10_000 for i, _ in got)
    assert sum((i, n) in held for i, n in planted.items()) >= 0.9 * len(planted)
