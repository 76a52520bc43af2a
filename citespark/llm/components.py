"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import few_files
from citespark.session import cut_lineage


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) of the edges (a, b); a component is named by its least node.

    Large-star and small-star steps in turn, until the edges stay the same: every node then points to its component's
    least node. Each step is a minimum per node and a join, so a node with very many neighbours is pre-aggregated and its
    rows can be split by the join. Each round is written to the shared folder. Loops, repeated edges and null ends are
    ignored; no edges give no rows. ``most``: there are no more edges than that, if it is known.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut_lineage(now if most is None else few_files(now, most))
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(few_files(large.where("u != v").distinct(), state[0]))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(few_files(small.union(least.select("u", F.col("m").alias("v"))).distinct(), state[0]))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
