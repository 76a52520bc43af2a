"""Connected components of a graph of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from citespark.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: each node of ``nodes(id)`` with the least id that ``edges(src, dst)`` tie it to.

    In a round every node takes the least label around it and then the label of its label; a label is always a node of
    the same component, so the second step doubles the reach. Labels only fall, so it ends, in about the logarithm of the
    longest way for usual graphs. A neighbour's label is a minimum, so hot nodes are pre-aggregated. Directions, loops,
    repeated edges and edges to unknown nodes do not matter.
    """
    both = edges.where("src != dst").select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e")).select("e.*").distinct()
    known = nodes.select("id").distinct()
    both = cut_lineage(both.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "other"), "other", "left_semi"))
    now = known.withColumn("component", F.col("id"))
    while True:
        around = both.join(now.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(
            F.min("component").alias("_least"))
        low = now.join(around, "id", "left").select(
            "id", F.col("component").alias("_old"), F.least("component", "_least").alias("_low"))
        low = cut_lineage(low)
        up = low.select(F.col("id").alias("_low"), F.col("_low").alias("component"))
        seen = Observation()
        now = cut_lineage(low.join(up, "_low").select("id", "component", "_old").observe(
            seen, F.count_if(F.col("component") != F.col("_old")).alias("changed"))).select("id", "component")
        if not seen.get["changed"]:
            return now
