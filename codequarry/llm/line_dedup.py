"""Line dedup, by DataFrame functions only.

Lines are exploded and reduced to 128 bits of hash of their normal form; one
aggregation with map-side combine finds the forms that several documents hold.
Only (document, position) of lines to drop come back, never the text of lines,
and each document's text meets its own list of positions once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import WHITESPACE, cut, lower_ascii, read, replace_column

LAST_ID = 2**63 - 1


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """All columns of docs with text_col reassembled, and n_lines and n_dropped.

    A line's key is the line without ASCII white space at both ends and with
    A-Z lower-cased. Keys of min_chars code points or more that at least two
    documents hold stay in the smallest id holding them and go elsewhere.

    Null or empty text: one empty line, which stays; null becomes ''. Rows with
    a null id count as one document with the largest id. Rows with an equal id are one
    document. An empty table gives an empty table. Columns of docs that are named
    n_lines or n_dropped are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns({
        "__cq_id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)),
        "__cq_text": F.coalesce(F.col(f"`{text_col}`"), F.lit("")),
    })
    rows = rows.withColumn("__cq_th", F.xxhash64("__cq_text"))
    lines = rows.select("__cq_id", "__cq_th", F.posexplode(F.split("__cq_text", "\n", -1)).alias("__cq_pos", "__cq_line"))
    key = lower_ascii(F.btrim(F.col("__cq_line"), F.lit(WHITESPACE)))
    hashed = cut(  # lines are exploded and hashed once, and read twice
        lines.withColumn("__cq_key", key)
        .where(F.char_length("__cq_key") >= min_chars)
        .select("__cq_id", "__cq_th", "__cq_pos", F.xxhash64("__cq_key").alias("__cq_h1"), F.xxhash64(F.lit(7), "__cq_key").alias("__cq_h2"))
    )
    # cut, so that it is a side of its own and a line of very many documents can be split between tasks
    shared = cut(
        hashed.groupBy("__cq_h1", "__cq_h2")
        .agg(F.min("__cq_id").alias("__cq_first"), F.max("__cq_id").alias("__cq_last"))
        .where("__cq_first < __cq_last")
        .select("__cq_h1", "__cq_h2", "__cq_first")
    )
    gone = (
        hashed.join(shared, ["__cq_h1", "__cq_h2"])
        .where("__cq_id <> __cq_first")
        .groupBy("__cq_id", "__cq_th")
        .agg(F.array_sort(F.collect_set("__cq_pos")).alias("__cq_gone"))
    )
    found = rows.join(gone, ["__cq_id", "__cq_th"], "left")
    # One boolean a line up to the last dropped one: a look-up by position, however many lines go.
    flags = F.flatten(F.transform("__cq_gone", lambda p, k: F.concat(
        F.array_repeat(F.lit(False), p - F.when(k == 0, F.lit(-1)).otherwise(F.get("__cq_gone", k - 1)) - 1),
        F.array(F.lit(True)),
    )))
    # zip_with evaluates both arrays once; a lambda that looked flags up would make them anew for each line
    kept_lines = F.zip_with(F.split("__cq_text", "\n", -1), flags, lambda x, gone: F.when(~F.coalesce(gone, F.lit(False)), x))
    joined = F.when(F.col("__cq_gone").isNull(), F.col("__cq_text")).otherwise(F.array_join(kept_lines, "\n"))
    lines_in = (F.char_length("__cq_text") - F.char_length(F.replace(F.col("__cq_text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return found.select(
        *[joined.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
        lines_in.alias("n_lines"),
        F.when(F.col("__cq_gone").isNull(), F.lit(0)).otherwise(F.size("__cq_gone")).cast("long").alias("n_dropped"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the repeated lines out of their texts and n_chars made anew; every document stays."""
    out = drop_repeated_lines(docs).select(*docs.columns)
    return replace_column(out, "n_chars", F.char_length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, row, t.i AS pos, t.line AS line,
         translate(trim(t.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) t
), f AS (
  SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT l.*, (f.first IS NOT NULL AND l.doc_id <> f.first) AS gone FROM l LEFT JOIN f ON l.k = f.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY row
"""
