"""Connected components of a large edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, root for every node that has an edge; root is the smallest node it reaches.

    A round points each node's larger neighbours at the smallest node of its
    neighbourhood, then each node's smaller ones likewise. Neighbourhoods are only ever
    reduced to a minimum, never gathered, so a node with very many edges costs no
    more than its edges do. Each round is written to the shared folder. Rounds grow
    with the logarithm of the longest chain.
    """
    x = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    now = cut(edges.where(F.col(a) != F.col(b)).select(*x).distinct())
    size = None
    for _ in range(most_rounds):
        # large star: hi neighbours of u go to the least of u and its neighbours, which is u unless u has smaller ones.
        # The least ones are cut off so that a node with very many edges can be split between tasks.
        least = cut(now.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        large = now.join(least, F.col("lo") == F.col("u"), "left").select(F.coalesce("m", "lo").alias("lo"), "hi").distinct()
        # small star: u and its smaller neighbours go to the least of them
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        next_ = large.join(small, "hi").select(F.col("m").alias("lo"), F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"))
        next_ = cut(next_.unionByName(small.select(F.col("m").alias("lo"), "hi")).where("lo <> hi").distinct())
        # a fixed point is a forest of stars: no node is both a centre and a leaf, and each leaf has one centre
        found = next_.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("x")).first()
        now = next_
        if found == size:
            break
        size = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
