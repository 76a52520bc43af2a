"""Networks of communities by period, and two-mode networks between kinds of nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions import period_of, ratio
from citespark.functions.columns import PERIOD_BOUNDS
from citespark.operators.network import attach_to_ends, merge_node_universe, pairwise_jaccard
from citespark.operators.series import complete_grid
from citespark.session import cut_lineage


def edges_with_periods(edges: DataFrame, nodes: DataFrame, bounds: Sequence[int] = PERIOD_BOUNDS) -> DataFrame:
    """Community, year and period of both ends of each (distinct) edge; ends without year drop out."""
    out = attach_to_ends(edges, nodes, ["com", "PY"], suffixes=("1", "2")).dropna(subset=["PY1", "PY2"])
    return out.withColumns({"P1": period_of("PY1", bounds), "P2": period_of("PY2", bounds)})


def _between_communities(edges_p: DataFrame) -> DataFrame:
    """Undirected weights between different communities inside one period, as a stage table."""
    return cut_lineage(
        edges_p.where((F.col("P1") == F.col("P2")) & (F.col("com1") != F.col("com2")))
        .groupBy(F.least("com1", "com2").alias("com1"), F.greatest("com1", "com2").alias("com2"), F.col("P1").alias("P"))
        .agg(F.sum("weight").alias("weight"))
    )


def _scaled(df: DataFrame) -> DataFrame:
    """``weight`` = adjusted weight over the largest one of all periods."""
    top = df.agg(F.max("weight_adj")).scalar()
    return df.withColumn("weight", ratio("weight_adj", top))


def period_coupling_network(edges_p: DataFrame, panel_p: DataFrame) -> DataFrame:
    """Coupling per period as weight over the product of both community sizes, scaled."""
    size = panel_p.select("com", "P", "n")
    out = _between_communities(edges_p)
    for end in ("1", "2"):
        out = out.join(size.withColumnsRenamed({"com": "com" + end, "n": "n" + end}), ["com" + end, "P"], "left")
    out = out.withColumnRenamed("weight", "weight_sum").withColumn("weight_adj", ratio("weight_sum", F.col("n1") * F.col("n2")))
    return _scaled(out).select("com1", "com2", "P", "weight_sum", "weight_adj", "weight")


def overall_coupling_network(period_network: DataFrame) -> DataFrame:
    """All periods together: summed adjusted weights, scaled."""
    out = period_network.groupBy("com1", "com2").agg(F.sum("weight_adj").alias("weight_adj"))
    return _scaled(out)


def overall_cocitation_network(period_network: DataFrame) -> DataFrame:
    """All periods together, as for coupling: summed adjusted weights, scaled."""
    return overall_coupling_network(period_network)


def overall_two_mode_network(period_network: DataFrame) -> DataFrame:
    """All periods together: parallel edges of the periods merged by their largest weight."""
    return period_network.groupBy("com1", "com2").agg(F.max("weight").alias("weight"))


def with_all_periods(period_network: DataFrame, overall: DataFrame, panel_p: DataFrame) -> DataFrame:
    """The network of each period, and the overall one as the period after the panel's last."""
    last = panel_p.agg(F.max("P")).scalar()
    columns = ["com1", "com2", "P", "weight"]
    return period_network.select(columns).unionByName(overall.withColumn("P", last + 1).select(columns))


def period_cocitation_network(edges_p: DataFrame) -> DataFrame:
    """Co-citation per period as Jaccard of the degrees of both communities in the period, scaled."""
    pairs = _between_communities(edges_p)
    both = pairs.unionByName(pairs.select(F.col("com2").alias("com1"), F.col("com1").alias("com2"), "P", "weight"))
    jac = pairwise_jaccard(both, "com1", "com2", "weight", ["P"], "weight_adj").where(F.col("com1") < F.col("com2"))
    return _scaled(jac.withColumnRenamed("weight", "weight_sum")).where(F.col("weight") > 0)


def two_mode_year(edges_2m: DataFrame, t_min: int | None = None, t_max: int | None = None, bounds: Sequence[int] = PERIOD_BOUNDS) -> DataFrame:
    """Complete (research area x knowledge base x year) grid with counts and yearly Jaccard.

    ``edges_2m``: one row per citation with ``com_bib, com_cit, PY``.
    """
    keys = ["com_bib", "com_cit", "PY"]
    # the one pass over the citations; all later steps read this small table several times
    count = cut_lineage(edges_2m.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight_count")))
    full = complete_grid(count, keys).join(count, keys, "left").withColumn(
        "weight_count", F.coalesce("weight_count", F.lit(0).cast("long")))
    out = pairwise_jaccard(full, "com_bib", "com_cit", "weight_count", ["PY"], "weight")
    if t_min is not None:
        out = out.where(F.col("PY") >= t_min)
    if t_max is not None:
        out = out.where(F.col("PY") <= t_max)
    return out.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "P": period_of("PY", bounds)})


def two_mode_period(by_year: DataFrame) -> DataFrame:
    """The same per period: Jaccard of the summed counts, scaled."""
    per = by_year.where(F.col("P").isNotNull()).groupBy(F.col("com_bib").alias("com1"), F.col("com_cit").alias("com2"), "P").agg(
        F.sum("weight").alias("weight_sum"), F.sum("weight_count").alias("weight_count"))
    jac = pairwise_jaccard(per, "com1", "com2", "weight_count", ["P"], "weight_adj")
    return _scaled(jac.withColumn("weight_adj", F.coalesce("weight_adj", F.lit(0.0))))


def topic_two_mode(gamma: DataFrame, docs: DataFrame, panel_p: DataFrame, key: str = "EID") -> DataFrame:
    """Community x topic x period: summed topic weight over the size of the community."""
    rows = gamma.join(docs.select(F.col(key).alias("document"), "com", "P"), "document")
    keys = ["com", "topic", "P"]
    per = cut_lineage(rows.groupBy(*keys).agg(F.sum("gamma").alias("_w")))  # the grid reads it once a key
    full = complete_grid(per, keys).join(per, keys, "left").join(panel_p.select("com", "P", "n"), ["com", "P"], "left")
    return full.select(*keys, F.coalesce(ratio("_w", "n"), F.lit(0.0)).alias("weight"))


def community_topic_edges(gamma: DataFrame, docs: DataFrame, key: str = "EID") -> DataFrame:
    """Community x topic: summed weight and its pairwise Jaccard."""
    rows = gamma.join(docs.select(F.col(key).alias("document"), "com"), "document")
    per = rows.groupBy(F.col("com").alias("from"), F.col("topic").alias("to")).agg(F.sum("gamma").alias("weight_count"))
    return pairwise_jaccard(per, "from", "to", "weight_count", name="weight")


def node_sizes_two_mode(panel_a: DataFrame, panel_b: DataFrame, kinds: tuple[str, str] = ("bib", "cit")) -> DataFrame:
    """Relative sizes ``n / max(n)`` of both node kinds per period."""
    parts = []
    for kind, p in zip(kinds, (panel_a, panel_b)):
        top = p.agg(F.max("n")).scalar()
        parts.append(p.select(F.lit(kind).alias("kind"), "com", "P", ratio("n", top).alias("n_rel")))
    return parts[0].unionByName(parts[1])


def period_node_strength(network: DataFrame, names: DataFrame) -> DataFrame:
    """Strength of each community per period over the largest of the period; every name is kept."""
    edges = network.select(F.col("com1").alias("src"), F.col("com2").alias("dst"), "P", "weight")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "P", "weight")
    strength = ends.groupBy("id", "P").agg(F.sum("weight").alias("dgr"))
    periods = network.select("P").distinct().agg(F.sort_array(F.collect_set("P"))).scalar()
    universe = names.select(F.col("com").alias("id"), periods.alias("_p")).select("id", F.explode("_p").alias("P"))
    return merge_node_universe(universe, strength, "dgr", ["P"])


__all__ = [
    "edges_with_periods", "period_coupling_network", "overall_coupling_network", "period_cocitation_network",
    "two_mode_year", "two_mode_period", "topic_two_mode", "community_topic_edges", "node_sizes_two_mode",
    "period_node_strength",
]
