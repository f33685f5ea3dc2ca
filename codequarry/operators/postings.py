"""Inverted index: dictionary, postings, and the set operations on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dictionary(terms: DataFrame, term: str = "term") -> DataFrame:
    """term_id, term: ids are hashes of the terms, so that no run needs another's numbering."""
    return terms.select(F.col(term).alias("term")).where("term IS NOT NULL").distinct().select(F.xxhash64("term").alias("term_id"), "term")


def postings(docs: DataFrame, doc_id: str, terms: Column, wanted: Sequence | None = None) -> DataFrame:
    """(term, doc) pairs of an array of terms a document, each once if ids are unique. wanted: no others become rows."""
    each = F.array_distinct(terms)
    if wanted is not None:
        each = F.array_intersect(each, F.array(*[F.lit(t) for t in wanted]))
    return docs.select(F.explode(each).alias("term"), F.col(doc_id))


def clustered(post: DataFrame, partitions: int, term: str = "term_id", doc: str = "fragment_id") -> DataFrame:
    """Postings in ranges of terms, sorted by term: Parquet's statistics then skip all but one range of a term.

    A common term has several ranges, which its documents divide. Within one they aren't sorted: numbers of one column are sorted by their digits, without comparing.
    """
    return post.repartitionByRange(partitions, term, doc).sortWithinPartitions(term)


def intersect(post: DataFrame, doc: str, wanted: Sequence, term: str = "term") -> DataFrame:
    """Documents with every wanted term; no term wanted is every document, a missing one none."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return post.select(doc).distinct()
    hit = post.where(F.col(term).isin(wanted))
    return hit.groupBy(doc).agg(F.countDistinct(term).alias("n")).where(F.col("n") == len(wanted)).select(doc)


def intersect_by_semi_joins(post: DataFrame, doc: str, wanted: Sequence, term: str = "term") -> DataFrame:
    """The same, one semi-join a term; better if the first terms are rare."""
    first, *rest = list(dict.fromkeys(wanted))
    out = post.where(F.col(term) == first).select(doc)
    for t in rest:
        out = out.join(post.where(F.col(term) == t).select(doc), doc, "left_semi")
    return out.distinct()


def union(post: DataFrame, doc: str, wanted: Sequence, term: str = "term") -> DataFrame:
    return post.where(F.col(term).isin(list(wanted))).select(doc).distinct()


def document_frequency(post: DataFrame, doc: str, term: str = "term") -> DataFrame:
    return post.groupBy(term).agg(F.count(doc).alias("df"))


def containing_groups(post: DataFrame, groups: DataFrame, doc: str, term: str = "term") -> DataFrame:
    """(group, doc) for each group all of whose terms the document has. groups: group, term."""
    size = groups.groupBy("group").agg(F.countDistinct(term).alias("size"))
    hit = post.join(groups.distinct(), term).groupBy("group", doc).agg(F.countDistinct(term).alias("n"))
    return hit.join(F.broadcast(size) if groups.limit(10_001).count() <= 10_000 else size, "group").where("n = size").select("group", doc)


def anchors(frequency: DataFrame, groups: DataFrame, term: str = "term", most: int | None = None) -> DataFrame:
    """The rarest term of each group (ties by name), and its df; groups with a term nobody has, or rarer than most, go."""
    joined = groups.join(frequency, term, "left")
    out = joined.groupBy("group").agg(F.min(F.struct("df", term)).alias("a"), F.count("*").alias("size"), F.count("df").alias("found"))
    out = out.where("size = found").select("group", F.col(f"a.{term}").alias(term), "a.df")
    return out if most is None else out.where(F.col("df") <= most)


def candidate_scores(post: DataFrame, doc: str, required: Sequence, optional: Sequence, term: str = "term") -> DataFrame:
    """10 for each required and 1 for each optional term that a document has; all required ones must be there."""
    need, may = F.col(term).isin(list(required)), F.col(term).isin(list(optional))
    out = post.where(need | may).groupBy(doc).agg(
        F.count(F.when(need, 1)).alias("required"), F.count(F.when(may, 1)).alias("optional")
    )
    return out.where(F.col("required") == len(set(required))).select(doc, (10 * F.col("required") + F.col("optional")).alias("score"))


def bm25(post: DataFrame, lengths: DataFrame, wanted: Sequence, doc: str, *, k1: float = 1.2, b: float = 0.75, term: str = "term") -> DataFrame:
    """Scores of documents with any wanted term. post: term, doc, tf (one row a pair). lengths: doc, len, of all documents."""
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))  # one row
    hit = post.where(F.col(term).isin(list(wanted)))
    df = hit.groupBy(term).agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return hit.join(df, term).join(lengths, doc).join(F.broadcast(stats)).groupBy(doc).agg(F.sum(part).alias("score"))
