"""Language identification by Bayesian fusion of evidence.

A document's language is judged from its text (trigrams of letters under each
language), the language that its markup declares, and a prior of its host. Host
priors are smoothed towards the prior of the host's address suffix, and that towards
the prior of the whole corpus; all three, and how often each language is declared as
which, come from grouped sums of the text's own posteriors over all documents.

Trigram models are fitted for every declared language, on at most FIT_ROWS documents each, by
hash of their ids: first those of 100 to FIT_BYTES bytes, if they are too few windows of FIT_BYTES of longer ones, then
shorter ones if those have less than ENOUGH bytes. Documents that the first fit assigns to another language than declared are left out of
the second, unless that is all of a language.
Counts, priors and decisions cover all documents and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import BROADCAST_ROWS, buffers, cut, keys_side, read, steps
from codequarry.ship import map_arrow

FIT_ROWS, FIT_BYTES = 200, 8192
#: With so many bytes of longer texts a language needs no short ones, whose few trigrams the fit can hardly check.
ENOUGH = 20_000
#: Trigrams of a text count as this many independent ones at most.
EVIDENCE = 40.0
#: Pseudo-documents with which a level of the prior leans on the one above.
KAPPA = 20.0
UNKNOWN = "und"
_BUCKETS = 131_071
#: Bytes of text that one step reads, and trigrams that it looks up at once: both bound a worker's memory.
STEP, _AT_ONCE = 1 << 19, 1 << 17
_SIGN = np.zeros(256, np.int32)
_SIGN[97:123] = _SIGN[65:91] = np.arange(1, 27)
_SIGN[128:] = 27 + (np.arange(128) & 63)


def _trigrams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each place, and which places count: three bytes of one row, not all of them without letters."""
    s = _SIGN[data]
    n = len(s)
    if n < 3:
        return np.zeros(n, np.int32), np.zeros(n, bool)
    code = np.zeros(n, np.int32)
    np.multiply(s[:-2], 8281, out=code[:-2])
    code[:-2] += s[1:-1] * 91
    code[:-2] += s[2:]
    counts = code > 0
    for k in (1, 2):
        last = ends[1:] - k
        counts[last[last >= 0]] = False
    np.remainder(code, _BUCKETS, out=code)
    return code, counts


@dataclass
class Model:
    """Log-probabilities of trigrams, for each language and then for text of none: buckets, their values, and the value of all others."""

    languages: list[str]
    rows: list[tuple[np.ndarray, np.ndarray, float]]

    def likelihoods(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tempered log-likelihoods of each row: its mean a trigram, times their number or EVIDENCE if that is less."""
        n, out = np.zeros(len(ends) - 1, np.int64), np.zeros((len(ends) - 1, len(self.rows)))
        table = np.empty(_BUCKETS, np.float32)
        for lo in range(0, len(data), STEP):  # a long text takes several steps, which share two bytes
            hi = min(len(data), lo + STEP + 2)
            r, q = np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, hi, "left")
            own = np.clip(ends[r : q + 1] - lo, 0, hi - lo)
            code, counts = _trigrams(data[lo:hi], own)
            if hi < len(data):
                counts[-2:] = False  # the next step's
            at = np.searchsorted(np.flatnonzero(counts), own)
            code = code[counts]
            n[r:q] += np.diff(at)
            for k, (buckets, values, rest) in enumerate(self.rows):
                table.fill(rest)
                table[buckets] = values
                for i in range(0, len(code), _AT_ONCE):
                    some = table[code[i : i + _AT_ONCE]]
                    total = np.zeros(len(some) + 1)
                    np.cumsum(some, out=total[1:])
                    out[r:q, k] += np.diff(total[np.clip(at - i, 0, len(some))])
        out *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
        out[n == 0, :-1] = -50.0  # nothing to read is no language
        return out


def posterior(ll: np.ndarray) -> np.ndarray:
    p = np.exp(ll - ll.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _fit_once(texts: list[str], langs: list[str]) -> Model:
    by: dict[str, list[str]] = {}
    for t, x in zip(texts, langs):
        by.setdefault(x, []).append(t)
    names, rows = [], []
    for name in sorted(by):
        code, counts = _trigrams(*buffers(pa.array(by[name], pa.string())))
        if counts.any():
            count = np.bincount(code[counts], minlength=_BUCKETS) + 0.02
            values, buckets = np.log(count / count.sum()).astype(np.float32), np.flatnonzero(count > 1).astype(np.int32)
            names.append(name)
            rows.append((buckets, values[buckets], float(np.log(0.02 / count.sum()))))
    none = np.zeros(0, np.int32), np.zeros(0, np.float32), float(-np.log(60.0**3 / 6))  # letters in any order
    return Model(names, [*rows, none])


def fit(texts: list[str], langs: list[str]) -> Model:
    """A model of all languages whose texts have trigrams."""
    model = _fit_once(texts, langs)
    if model.languages:
        best = np.argmax(np.concatenate([model.likelihoods(*buffers(pa.array(texts[i : i + 500], pa.string()))) for i in range(0, len(texts), 500)])[:, :-1], axis=1)
        same = [model.languages[b] == x for b, x in zip(best.tolist(), langs)]
        sure = {x for x, ok in zip(langs, same) if ok}
        some = [(t, x) for t, x, ok in zip(texts, langs, same) if ok or x not in sure]
        model = _fit_once([t for t, _ in some], [x for _, x in some])
    return model


def learn(rows: DataFrame) -> Model:
    """A model from rows with __cq_id, __cq_text and __cq_declared.

    One pass counts the texts of each language and tier of length, one more brings the few of each language's first tier whose
    hashes lie below the bound that leaves about twice FIT_ROWS. A bound that leaves too few is raised, and a tier that has too few is
    followed by the next.
    """
    size, chars, key = F.octet_length("__cq_text"), F.char_length("__cq_text"), F.col("__cq_declared")
    some = rows.where(key.isNotNull() & (size >= 3) & F.col("__cq_text").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")).select("__cq_id", "__cq_declared", "__cq_text")
    some = some.withColumn("tier", F.when(size > FIT_BYTES, 1).when(size >= 100, 0).otherwise(2))
    counts: dict[str, dict[int, int]] = {}
    for r in some.groupBy(key, "tier").count().collect():
        counts.setdefault(r["__cq_declared"], {})[r["tier"]] = r["count"]
    some = some.withColumn("th", F.xxhash64("__cq_text")).withColumn("h", F.shiftrightunsigned(F.xxhash64("__cq_id", "th"), 1))
    most = F.floor(FIT_BYTES * chars / size).cast("int")
    window = F.when(size <= FIT_BYTES, F.col("__cq_text")).otherwise(F.substring("__cq_text", (1 + F.pmod("h", chars - most + 1)).cast("int"), most))
    found: dict[str, list[str]] = {name: [] for name in sorted(counts)}

    def first_share(name):
        tier = min(counts[name])
        return tier, min(1.0, 2 * (FIT_ROWS - len(found[name])) / counts[name].pop(tier))

    shares = {name: first_share(name) for name in found}
    while shares:
        bounds = rows.sparkSession.createDataFrame([(name, tier, min(int(share * 2.0**63), 2**63 - 1)) for name, (tier, share) in shares.items()], "__cq_declared string, tier int, bound long")
        below = some.join(F.broadcast(bounds), ["__cq_declared", "tier"]).where("h <= bound").groupBy("__cq_declared", "h", "__cq_id", "th").agg(F.min(window).alias("text"))
        got: dict[str, list] = {}
        for r in below.collect():
            got.setdefault(r["__cq_declared"], []).append(((r["h"], r["__cq_id"] is None, r["__cq_id"] or 0, r["th"]), r["text"]))
        again = {}
        for name, (tier, share) in shares.items():
            texts = [t for _, t in sorted(got.get(name, []))][: FIT_ROWS - len(found[name])]
            if share < 1 and len(found[name]) + len(texts) < FIT_ROWS:
                again[name] = tier, min(1.0, 8 * share)
                continue
            found[name] += texts
            if len(found[name]) < FIT_ROWS and counts[name] and (min(counts[name]) < 2 or sum(len(t.encode()) for t in found[name]) < ENOUGH):
                again[name] = first_share(name)
        shares = again
    return fit([t for texts in found.values() for t in texts], [name for name, texts in found.items() for _ in texts])


def suffix_of(host: Column) -> Column:
    """The last label of a host name; empty without a dot, as with numbers."""
    return F.coalesce(F.regexp_extract(host, r"\.([A-Za-z][^.]*)$", 1), F.lit(""))


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """Narrow rows: __cq_id, __cq_th, __cq_declared, __cq_host and ll."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__cq_text", STEP):
                ll = shared.value.likelihoods(*buffers(part.column("__cq_text")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1, dtype=np.int32) * ll.shape[1]), pa.array(ll.ravel()))
                names = ["__cq_id", "__cq_th", "__cq_declared", "__cq_host"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), flat], [*names, "ll"])

    return map_arrow(rows.select("__cq_id", "__cq_th", "__cq_declared", "__cq_host", "__cq_text"), run, "__cq_id long, __cq_th long, __cq_declared string, __cq_host string, ll array<double>")


def _normal(ll: Column) -> Column:
    e = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source") -> DataFrame:
    """doc_id, text_hash, lang, posterior, declared and kept, for each row.

    lang is "und" where no letters or no language fits; such rows are not kept, nor are those whose best language has less than
    half of the posterior, but for rows that declare a language without a model (none of its texts has letters). A null or absent declaration or host is no evidence: the former weighs nothing, the
    latter has the prior of hosts without a suffix. Null and empty texts have no letters. Without any
    declared language there is nothing to learn from: all rows are "und" and kept. Repeated rows each give a
    row. An empty table gives none.
    """
    pick = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("__cq_id"), F.coalesce(pick(text_col), F.lit("")).alias("__cq_text"),
        F.nullif(F.lower(F.regexp_extract(pick(declared_col), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit("")).alias("__cq_declared"),
        F.coalesce(F.lower(pick(host_col)), F.lit("")).alias("__cq_host"),
    ).withColumn("__cq_th", F.xxhash64("__cq_text"))
    model = learn(rows)
    names, n = model.languages, len(model.languages) + 1
    if n == 1:
        return rows.select(F.col("__cq_id").alias("doc_id"), F.col("__cq_th").alias("text_hash"), F.lit(UNKNOWN).alias("lang"), F.lit(1.0).alias("posterior"), F.col("__cq_declared").alias("declared"), F.lit(True).alias("kept"))
    scored = cut(_scored(rows, model).withColumn("p", _normal(F.col("ll"))))
    sums = lambda prefix: [F.sum(F.col(prefix)[i] if prefix == "p" else F.col(f"{prefix}{i}")) for i in range(n)]
    hosts = scored.groupBy("__cq_host").agg(*[s.alias(f"h{i}") for i, s in enumerate(sums("p"))]).withColumn("suffix", suffix_of(F.col("__cq_host")))
    suffixes = hosts.groupBy("suffix").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums("h"))])
    whole = suffixes.agg(*[s.alias(f"w{i}") for i, s in enumerate(sums("s"))]).first()
    total = sum(x or 0.0 for x in whole) + n
    world = [((x or 0.0) + 1) / total for x in whole]
    s_all, h_all = (sum((F.col(f"{c}{i}") for i in range(n)), F.lit(0.0)) for c in "sh")
    prior_s = [(F.col(f"s{i}") + KAPPA * world[i]) / (s_all + KAPPA) for i in range(n)]
    prior_h = F.array(*[F.log((F.col(f"h{i}") + KAPPA * prior_s[i]) / (h_all + KAPPA)) for i in range(n)])
    # priors are wider than keys, so fewer are broadcast
    hosts = keys_side(hosts.join(suffixes, "suffix").select("__cq_host", prior_h.alias("prior")), BROADCAST_ROWS // 10)
    # how often documents of each language declare what
    said = scored.where("__cq_declared IS NOT NULL").groupBy("__cq_declared").agg(*[s.alias(f"d{i}") for i, s in enumerate(sums("p"))])
    of = said.agg(*[F.sum(f"d{i}") for i in range(n)], F.count("*").alias("kinds")).first()
    declared = said.select("__cq_declared", F.array(*[F.log((F.col(f"d{i}") + 0.5) / ((of[i] or 0.0) + 0.5 * (of["kinds"] + 1))) for i in range(n)]).alias("declares"))
    joined = scored.join(hosts, "__cq_host").join(declared, "__cq_declared", "left")
    fused = F.zip_with(F.zip_with("ll", "prior", lambda a, b: a + b), F.coalesce("declares", F.array_repeat(F.lit(0.0), n)), lambda a, b: a + b)
    out = joined.withColumn("p", _normal(fused)).withColumn("best", F.array_position("p", F.array_max("p")))
    return out.select(
        F.col("__cq_id").alias("doc_id"), F.col("__cq_th").alias("text_hash"),
        F.element_at(F.array(*[F.lit(x) for x in [*names, UNKNOWN]]), F.col("best").cast("int")).alias("lang"),
        F.array_max("p").alias("posterior"), F.col("__cq_declared").alias("declared"),
        (((F.array_max("p") >= 0.5) & (F.col("best") < n)) | F.coalesce(~F.col("__cq_declared").isin(names), F.lit(False))).alias("kept"),
    )


def page_fields(pages: DataFrame) -> DataFrame:
    """pages with text (html without scripts, styles and tags), declared (the root's lang) and host, for identify()."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return pages.select("page_id", text.alias("text"), F.regexp_extract(html, r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
                        F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"://([^/?#:]*)", 1).alias("host"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are kept, as they are; only the rejected ones' keys meet the texts."""
    gone = keys_side(identify(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__cq_gone"), F.col("text_hash").alias("__cq_th")))
    same = docs["doc_id"].eqNullSafe(F.col("__cq_gone")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__cq_th"))
    return docs.join(gone, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents")).select("doc_id", "lang", F.round("posterior", 6).alias("posterior"), "declared", "kept")


def pages_query(spark, sf_dir: str) -> DataFrame:
    """The same for pages, with a page's key: here the markup declares, and hosts have suffixes."""
    pages = cut(page_fields(read(spark, sf_dir, "pages")))  # tags are taken out once, not in each pass
    found = identify(pages, id_col="page_id", declared_col="declared", host_col="host")
    return found.select(F.col("doc_id").alias("page_id"), "lang", F.round("posterior", 6).alias("posterior"), "declared", "kept")
