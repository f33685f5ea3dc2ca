"""Findings: identity, dedup, counts and the difference of two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.joins import first_by

IDENTITY = ("check", "kind", "package", "version", "file", "place", "message")


def dedup(findings: DataFrame, identity: Sequence[str] = IDENTITY, order: Sequence[Column] | None = None) -> DataFrame:
    """The first finding of each identity."""
    return first_by(findings, list(identity), order or [F.col("id")])


def counted(findings: DataFrame, by: str, to: str = "n") -> DataFrame:
    """Counts by a column, most first, ties by value."""
    return findings.groupBy(by).agg(F.count("*").alias(to)).orderBy(F.desc(to), F.col(by).asc_nulls_last())


def diff(old: DataFrame, new: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """identity columns and status: new, removed or unchanged. Nulls are equal to each other; one shuffle of keys."""
    keys = list(identity)
    sides = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n")))
    merged = sides.groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    status = F.when((F.col("o") == 1) & (F.col("n") == 1), "unchanged").when(F.col("n") == 1, "new").otherwise("removed")
    return merged.select(*keys, status.alias("status"))
