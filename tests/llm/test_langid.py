"""Language ID: the fusion by plain arithmetic, and planted documents."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codequarry.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string"
STEMS = {
    "en": "the and that with from this have which their would there people other water about",
    "de": "und der nicht eine werden durch zwischen schon immer wasser große straße über können möchte",
    "fr": "les des une dans pour avec qui être cette plus leurs même après très où déjà",
    "es": "los las una para con que está como más pero sus también después donde año ningún",
}


def text(lang, pick, n=60):
    return " ".join(pick.choice(STEMS[lang].split()) for _ in range(n)) + "."


def fixture(n=400, seed=1):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        lang = pick.choice(list(STEMS))
        said = lang if pick.random() < 0.85 else pick.choice([*STEMS, None, "xx-nonsense-tag", ""])
        host = pick.choice([f"site{pick.randrange(4)}.{lang}.example", "mixed.example", "203.0.113.7", None])
        rows.append((i, text(lang, pick, pick.randint(3, 120)), said, host))
    rows += [(n, None, "en", "a.example"), (n + 1, "", "de", None), (n + 2, "12345 67890 !!! " * 20, "fr", "b.example"), (None, text("de", pick), None, None)]
    return rows


def plain(rows, model):
    """doc_id, lang, posterior, kept of each row, by loops over numbers."""
    n = len(model.languages) + 1
    ll = model.likelihoods(*langid.buffers(pa.array([t or "" for _, t, _, _ in rows])))
    p = langid.posterior(ll)
    host = [(h or "").lower() for *_, h in rows]
    suffix = [m[1] if (m := re.search(r"\.([A-Za-z][^.]*)$", h)) else "" for h in host]
    said = [m[1].lower() if s and (m := re.fullmatch(r"\s*([A-Za-z]{2,3})(?:[-_].*)?\s*", s)) else None for _, _, s, _ in rows]
    total = lambda keys, k: sum((p[i] for i in range(len(rows)) if keys[i] == k), np.zeros(n))
    world = (p.sum(axis=0) + 1) / (p.sum() + n)
    of = sum((p[i] for i in range(len(rows)) if said[i] is not None), np.zeros(n))
    kinds = len({s for s in said if s is not None})
    out = []
    for i, (doc, *_) in enumerate(rows):
        s, h = total(suffix, suffix[i]), total(host, host[i])
        ps = (s + langid.KAPPA * world) / (s.sum() + langid.KAPPA)
        score = ll[i] + np.log((h + langid.KAPPA * ps) / (h.sum() + langid.KAPPA))
        if said[i] is not None:
            score = score + np.log((total(said, said[i]) + 0.5) / (of + 0.5 * (kinds + 1)))
        q = np.exp(score - score.max())
        q /= q.sum()
        k = int(q.argmax())
        out.append((doc, [*model.languages, langid.UNKNOWN][k], float(q[k]), bool(q[k] >= 0.5 and k < n - 1)))
    return out


def test_fusion_equals_plain_arithmetic(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    narrow = docs.select(F.col("doc_id").alias("__cq_id"), F.coalesce("text", F.lit("")).alias("__cq_text"), F.nullif(F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit("")).alias("__cq_declared"))
    model = langid.learn(narrow)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for doc, lang, p, kept in plain(rows, model):
        r = got[doc]
        assert (r["lang"], r["kept"]) == (lang, kept), doc
        assert r["posterior"] == pytest.approx(p, abs=1e-6)


def test_languages_are_told_apart_and_clean_documents_stay(spark):
    rows = fixture(600, 5)
    pick = random.Random(9)
    truth = {1000 + i: lang for i, lang in enumerate([*STEMS] * 20)}
    rows += [(i, text(lang, pick, 40), None, "new.example") for i, lang in truth.items()]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["lang"] == lang and got[i]["kept"] for i, lang in truth.items())
    # a wrong declaration does not outweigh a clear text
    wrong = [(i, t, s) for i, t, s, _ in rows if i is not None and i < 600 and s in STEMS and t and len(t) > 200]
    assert sum(got[i]["lang"] == max(STEMS, key=lambda x: sum(w in STEMS[x].split() for w in t[:-1].split())) for i, t, _ in wrong) >= 0.99 * len(wrong)
    assert all(not got[i]["kept"] and got[i]["lang"] == "und" for i in (600, 601, 602))


def test_host_and_declaration_decide_where_the_text_says_little(spark):
    pick = random.Random(2)
    rows = [(i, text("de", pick), "de", "zeitung.de.example") for i in range(150)] + [(200 + i, text("fr", pick), "fr", "journal.fr.example") for i in range(150)]
    # two words that, by the letters alone, are as likely German as French
    model = langid.fit([t for _, t, _, _ in rows], [x for _, _, x, _ in rows])
    pairs = [f"{a} {b}" for a in STEMS["de"].split() for b in STEMS["fr"].split()]
    ll = model.likelihoods(*langid.buffers(pa.array(pairs)))
    even = pairs[int(np.argmin(np.abs(ll[:, 0] - ll[:, 1]) + (ll[:, 2] > ll[:, 0]) * 1e3))]
    rows += [(500, even, "de", "zeitung.de.example"), (501, even, "fr", "journal.fr.example")]
    got = {r["doc_id"]: r["lang"] for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[500], got[501]) == ("de", "fr")


def test_no_declarations_repeats_empty_table_and_other_columns(spark):
    rows = [(1, "some words of text", None, None), (1, "some words of text", None, None), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], SCHEMA + ", posterior string, kept boolean")
    out = langid.identify(docs)
    assert out.columns == ["doc_id", "text_hash", "lang", "posterior", "declared", "kept"]
    assert [(r["lang"], r["kept"]) for r in out.collect()] == [("und", True)] * 3
    assert langid.identify(docs.limit(0)).count() == 0
    full = spark.createDataFrame([(*r, 1.0) for r in fixture(200, 3)], SCHEMA + ", p double")
    staged = langid.stage(spark, full.unionByName(full), "")
    kept = langid.identify(full.unionByName(full)).where("kept")
    assert staged.columns == full.columns and staged.count() == kept.count() and kept.count() % 2 == 0


def test_pages_declare_by_markup(spark):
    html = '<!doctype html><HTML class="x" lang="de-AT"><head><style>p {}</style><script>var the = 1</script></head><body><p>Grüße</p></body></HTML>'
    (r,) = langid.page_fields(spark.createDataFrame([(1, "https://www.a.example:8080/x", html)], "page_id long, url string, html string")).collect()
    assert (r["declared"], r["host"], r["text"].split()) == ("de-AT", "www.a.example", ["Grüße"])
    assert langid.page_fields(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")).first()["text"] == ""


def test_pages_are_judged_by_markup_and_suffix(spark, tmp_path):
    import __spark_entry__

    pick = random.Random(4)
    page = lambda body, lang: f'<html lang="{lang}"><body><script>the and that with</script><p>{body}</p></body></html>'
    rows = [(i, f"https://h{i}.{x}/a", page(text(x, pick), x)) for i, x in enumerate(["de", "fr"] * 150)]
    model = langid.fit([text(x, pick) for x in ["de", "fr"] * 150], ["de", "fr"] * 150)
    pairs = [f"{a} {b}" for a in STEMS["de"].split() for b in STEMS["fr"].split()]
    ll = model.likelihoods(*langid.buffers(pa.array(pairs)))
    even = pairs[int(np.argmin(np.abs(ll[:, 0] - ll[:, 1]) + (ll[:, 2] > ll[:, 0]) * 1e3))]
    # hosts of their own: nothing but the suffix, or the markup, tells these apart
    rows += [(500, "http://new1.de/", even), (501, "http://new2.fr/", even), (502, "http://203.0.113.7/", page(even, "de")), (503, "http://203.0.113.7/", page(even, "fr")), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = __spark_entry__.queries()["op4_language_id_pages"](spark, str(tmp_path))
    assert out.columns == ["page_id", "lang", "posterior", "declared", "kept"]
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and all(got[i]["lang"] == ["de", "fr"][i % 2] and got[i]["kept"] for i in range(300))
    assert [got[i]["lang"] for i in (500, 501, 502, 503)] == ["de", "fr", "de", "fr"] and not got[None]["kept"]


def test_every_declared_language_is_learned(spark):
    pick = random.Random(8)
    names = [f"q{chr(97 + i // 7)}{chr(97 + i % 7)}" for i in range(40)]
    stems = {x: ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randint(3, 7))) for _ in range(25)] for x in names}
    say = lambda x, n: " ".join(pick.choice(stems[x]) for _ in range(n))
    # the 33rd and later are declared less often; one language has short texts only, one has books only, one no letters
    rows = [(x, say(x, 60)) for k, x in enumerate(names) for _ in range(8 if k < 32 else 4)]
    stems |= {x: ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(25)] for x in ("sho", "boo")}
    rows += [("sho", say("sho", 9)) for _ in range(60)] + [("boo", say("boo", 3000)) for _ in range(3)] + [("dig", "12 345 - 6789 " * 20)] * 2
    docs = [(i, t, x, None) for i, (x, t) in enumerate(rows)]
    got = langid.identify(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert len(got) == len(docs) and all(r["kept"] for r in got)
    assert [(r["declared"], r["lang"]) for r in got if r["lang"] != ("und" if r["declared"] == "dig" else r["declared"])] == []
