"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.session import remove_staged, stage_table


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b): the smallest id it reaches.

    Each round lets every node link its larger neighbours to its smallest neighbour, then every
    node link its smaller neighbours to the smallest of them, until all trees are stars (a
    logarithmic number of rounds in practice). Each round is written to the shared folder, which
    cuts the lineage, and its predecessor is removed. A node with very many neighbours is pre-aggregated before the shuffle, and
    the join that spreads its minimum can be split by the adaptive planner. Loops, repeated edges
    and nulls in either column have no effect.
    """
    edges = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("a is not null and b is not null and a <> b").distinct()
    edges = stage_table(edges, name)
    before = None
    while True:
        both = edges.select("lo", "hi").unionAll(edges.select("hi", "lo")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = stage_table(large.where("hi <> lo").distinct(), name)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(small.select("hi", F.col("m").alias("lo")))
        before_edges, edges = edges, stage_table(small.where("hi <> lo").distinct(), name)
        remove_staged(before_edges, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
