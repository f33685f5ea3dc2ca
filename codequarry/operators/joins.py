"""Joins and window-like operators of the code-fact engine, over any columns.

All of them keep an equi key, so none plans a Cartesian product; the interval test is a
residual of a hash or sort-merge join, which adaptive execution can split where one key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def end_before_next(df: DataFrame, key: str, start: str, to: str = "end_line", last: int = 999_999) -> DataFrame:
    """Each row's end: the next distinct start within its key, less one; rows of one start all look past it."""
    later = Window.partitionBy(key).orderBy(F.col(start).cast("long")).rangeBetween(1, Window.unboundedFollowing)
    return df.withColumn(to, F.coalesce(F.min(F.col(start)).over(later) - 1, F.lit(last)))


def within(point: Column, start: Column, end: Column) -> Column:
    """start <= point <= end, a null end being open."""
    return (point >= start) & (end.isNull() | (point <= end))


def containment_join(intervals: DataFrame, facts: DataFrame, *, key: tuple[str, str], start: str, end: str, point: str, how: str = "inner") -> DataFrame:
    """Facts in the intervals of the same key. Column names of both sides must differ."""
    on = (F.col(key[0]) == F.col(key[1])) & within(F.col(point), F.col(start), F.col(end))
    return intervals.join(facts, on, how)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, which should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__cq_rn", F.row_number().over(w)).where("__cq_rn = 1").drop("__cq_rn")


def smallest_enclosing(facts: DataFrame, intervals: DataFrame, *, key: tuple[str, str], start: str, end: str, point: str, fact_id: str, size: Column, tie: Column) -> DataFrame:
    """Each fact with the smallest interval that holds it; facts that none holds stay, with nulls."""
    on = (F.col(key[0]) == F.col(key[1])) & within(F.col(point), F.col(start), F.col(end))
    joined = facts.join(intervals, on, "left")
    return first_by(joined, [fact_id], [size.asc_nulls_last(), tie.asc_nulls_last()])


def first_match(left: DataFrame, right: DataFrame, *, on: tuple[str, str], order: Sequence[Column]) -> DataFrame:
    """Each row of left with the first row of right under its key (a lateral first match)."""
    return left.join(first_by(right, [on[1]], order), F.col(on[0]) == F.col(on[1]))


def associated(root: DataFrame, facts: Sequence[tuple[DataFrame, str, str]], *, key: str, start: str, end: str, pair: tuple[str, str] | None = None) -> DataFrame:
    """One to three containment joins on one root; pair names two columns that must be equal besides."""
    if not 1 <= len(facts) <= 3:
        raise ValueError("one to three associations can be joined")
    out = root
    for df, fact_key, point in facts:
        out = containment_join(out, df, key=(key, fact_key), start=start, end=end, point=point)
    return out.where(F.col(pair[0]) == F.col(pair[1])) if pair else out


def enclosing_latest(points: DataFrame, intervals: DataFrame, *, key: tuple[str, str], start: str, end: str | None, point: str, point_id: str, value: str) -> DataFrame:
    """Each point with value of the interval around it that begins last; of equal beginnings the greatest value. A null end is open.

    With end None all intervals are open: then no point meets more than one, and one sort of both sides by key and place does.
    """
    if end is None:
        side = lambda k, place, is_point, id_, v: [F.col(k).alias("k"), F.col(place).alias("place"), F.lit(is_point).alias("rank"), id_.alias(point_id), v.alias(value)]
        both = points.select(*side(key[0], point, 0, F.col(point_id), F.lit(None))).unionByName(intervals.select(*side(key[1], start, 1, F.lit(None), F.col(value))))
        order = Window.partitionBy("k").orderBy("place", "rank", F.col(value).asc_nulls_first())  # points come before what begins at their place
        last = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        return both.select("rank", point_id, last.alias(value)).where("rank = 0").select(point_id, value)
    on = (F.col(key[0]) == F.col(key[1])) & (F.col(point) > F.col(start)) & (F.col(end).isNull() | (F.col(point) <= F.col(end)))
    joined = points.join(intervals, on, "left")
    return joined.groupBy(point_id).agg(F.max_by(value, F.struct(start, value)).alias(value))
