"""Diversity and cohesion of communities per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions import ordered_histogram, ratio
from citespark.functions.columns import PERIOD_BOUNDS

ALL = "X_all"  # Fixed value: label of the total rows


def gini(df: DataFrame, by: Sequence[str], x: str, name: str = "gini") -> DataFrame:
    """``(2 sum(i x_i) / sum(x) - (n + 1)) / n`` per group; null when all values are zero."""
    by = list(by)
    h = ordered_histogram(df, x, by)
    n, v = F.col("n"), F.col(x).cast("double")
    # n equal values take the ranks before+1 … before+n
    ranked = v * (F.col("before") * n + n * (n + 1) / F.lit(2))
    agg = h.groupBy(*by).agg(F.sum(ranked).alias("_r"), F.sum(v * n).alias("_s"), F.sum("n").alias("_n"))
    return agg.select(*by, ((ratio(F.col("_r") * 2, "_s") - (F.col("_n") + 1)) / F.col("_n")).alias(name))


def internal_degree_by_period(edges_p: DataFrame, bounds: Sequence[int] = PERIOD_BOUNDS, width: int = 10) -> DataFrame:
    """Strength inside each community among publications of the period, and up to its end.

    Period ``i`` covers ``width`` years before its bound; the number after the last one stands
    for all years. ``X_all`` rows measure the whole graph.
    """
    small = edges_p.groupBy("com1", "com2", "PY1", "PY2").agg(F.sum("weight").alias("w"))
    first, last = F.least("PY1", "PY2"), F.greatest("PY1", "PY2")
    slots = [
        F.named_struct(F.lit("P"), F.lit(i), F.lit("inside"), (first >= b - width) & (last < b), F.lit("upto"), last < b)
        for i, b in enumerate(bounds, 1)
    ]
    slots.append(F.named_struct(F.lit("P"), F.lit(len(bounds) + 1), F.lit("inside"), F.lit(True), F.lit("upto"), F.lit(True)))
    labels = F.when(
        F.col("com1") == F.col("com2"), F.array(F.col("com1").cast("string"), F.lit(ALL))
    ).otherwise(F.array(F.lit(ALL)))
    rows = small.select(F.explode(labels).alias("com"), "w", F.array(*slots).alias("_s"))
    rows = rows.select("com", "w", F.explode("_s").alias("_s")).select("com", "w", "_s.*")
    twice = F.col("w").cast("double") * 2
    return rows.groupBy("com", "P").agg(
        F.sum(F.when(F.col("inside"), twice).otherwise(0.0)).alias("dgr_int"),
        F.sum(F.when(F.col("upto"), twice).otherwise(0.0)).alias("dgr_int_cum"),
    )


def grand_total_rows(panel_p: DataFrame, values: Sequence[str] = ("n", "n_cum", "dgr_int", "dgr_int_cum")) -> DataFrame:
    """Adds ``X_all`` per period, then one further period made of the last cumulative values."""
    rows = panel_p.select(F.col("com").cast("string").alias("com"), "P", *values)
    total = rows.groupBy("P").agg(*[F.sum(v).alias(v) for v in values]).withColumn("com", F.lit(ALL))
    out = rows.unionByName(total)
    last = panel_p.agg(F.max("P")).scalar()
    overall = out.where(F.col("P") == last)
    cumulative = {v: F.col(v + "_cum") for v in values if v + "_cum" in values}
    return out.unionByName(overall.withColumns(cumulative).withColumn("P", F.col("P") + 1))


def cohesion_internal(rows: DataFrame, times: float = 1.0) -> DataFrame:
    """``times * dgr_int / (n (n - 1))``; 0 where undefined. Degrees that count each edge once take ``times`` = 2."""
    return rows.withColumn("coh_int", F.coalesce(ratio(F.col("dgr_int") * times, F.col("n") * (F.col("n") - 1)), F.lit(0.0)))


def panel_with_all_periods(panel_p: DataFrame) -> DataFrame:
    """``(com, P, n_cum)``, with the last period's cumulative size again as the period of all periods."""
    rows = panel_p.select("com", "P", "n_cum")
    return rows.unionByName(rows.where(F.col("P") == panel_p.agg(F.max("P")).scalar()).withColumn("P", F.col("P") + 1))


def _active(panel_p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities with publications so far, and their number per period."""
    alive = panel_p.where(F.col("n_cum") > 0).select("com", "P")
    return alive, alive.groupBy("P").agg(F.count(F.lit(1)).alias("N"))


def _among(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Weight between the members of each (com, P): ``members(com, P, id)``, ``edges(src, dst, P, weight)``."""
    one = members.withColumnRenamed("id", "src")
    two = members.withColumnRenamed("id", "dst")
    return edges.join(one, ["P", "src"]).join(two, ["P", "dst", "com"]).groupBy("com", "P").agg(F.sum("weight").alias("_among"))


def _index(base: DataFrame, balance: str, name: str) -> DataFrame:
    """Variety, balance, disparity and their product, undefined parts set to 0, 0 and 1."""
    out = base.withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "_among": F.coalesce("_among", F.lit(0.0))})
    density = ratio(F.col("_among") * 2, F.col("n") * (F.col("n") - 1))
    out = out.withColumns({
        "V": F.coalesce(ratio("n", "N_all"), F.lit(0.0)),
        "B": F.coalesce(F.col(balance), F.lit(0.0)),
        "D": F.coalesce(F.lit(1.0) - density, F.lit(1.0)),
    })
    return out.withColumn(name, F.col("V") * F.col("B") * F.col("D"))


def diversity_internal(
    two_mode_p: DataFrame, bases_p: DataFrame, panel_bib: DataFrame, panel_cit: DataFrame,
    cut: float = 0.025, balance: str = "1-gini",
) -> DataFrame:
    """Diversity of the knowledge bases used by each research area, per period, with an ``X_all`` row.

    ``two_mode_p(com1, com2, P, weight)`` links areas to bases, ``bases_p`` is the co-citation
    network of the bases. Links under ``cut`` do not count.
    """
    alive, n_all = _active(panel_cit)
    alive_bib, _ = _active(panel_bib)
    two_mode_p = two_mode_p.join(alive.withColumnRenamed("com", "com2"), ["com2", "P"], "left_semi")
    two_mode_p = two_mode_p.join(alive_bib.withColumnRenamed("com", "com1"), ["com1", "P"], "left_semi")
    named = two_mode_p.withColumn("com", F.col("com1").cast("string"))
    links = named.where(F.col("weight") >= cut)
    total = F.lit(ALL).alias("com")
    members = links.select("com", "P", F.col("com2").alias("id")).unionByName(
        links.select(total, "P", F.col("com2").alias("id")).distinct())
    # the total row balances all links, the others those that count
    weights = links.select("com", "P", "weight").unionByName(named.select(total, "P", "weight"))
    g = gini(weights, ["com", "P"], "weight", "_g")
    g = g.withColumn("_b", F.lit(1.0) - F.col("_g")) if balance == "1-gini" else g.withColumn("_b", F.col("_g"))
    n = members.groupBy("com", "P").agg(F.count(F.lit(1)).alias("n"))
    edges = bases_p.select(F.col("com1").alias("src"), F.col("com2").alias("dst"), "P", "weight")
    everyone = panel_bib.select(F.col("com").cast("string").alias("com"), "P").unionByName(panel_bib.select(total, "P").distinct())
    base = (
        everyone.join(n_all.withColumnRenamed("N", "N_all"), "P").join(n, ["com", "P"], "left")
        .join(g, ["com", "P"], "left").join(_among(edges, members), ["com", "P"], "left")
    )
    return _index(base, "_b", "div_int").select("com", "P", F.col("N_all").alias("N_bases"), "n", "V", "B", "D", "div_int")


def diversity_external(network_p: DataFrame, panel_bib: DataFrame, balance: str = "gini") -> DataFrame:
    """Diversity of the neighbours of each research area, per period, with an ``X_all`` row."""
    alive, n_all = _active(panel_bib)
    edges = network_p.select(F.col("com1").alias("src"), F.col("com2").alias("dst"), "P", "weight")
    for end in ("src", "dst"):
        edges = edges.join(alive.withColumnRenamed("com", end), [end, "P"], "left_semi")
    own = edges.select("P", "weight", F.explode(F.array(
        F.struct(F.col("src").alias("com"), F.col("dst").alias("id")),
        F.struct(F.col("dst").alias("com"), F.col("src").alias("id")))).alias("_e")).select("P", "weight", "_e.*")
    own = own.withColumn("com", F.col("com").cast("string"))
    total = F.lit(ALL).alias("com")
    members = own.select("com", "P", "id")
    weights = own.select("com", "P", "weight").unionByName(edges.select(total, "P", "weight"))
    g = gini(weights, ["com", "P"], "weight", "_g")
    if balance == "1-gini":
        g = g.withColumn("_g", F.lit(1.0) - F.col("_g"))
    # each edge counts at both ends of the whole graph
    n = members.groupBy("com", "P").agg(F.count(F.lit(1)).alias("n"))
    dgr = own.groupBy("com", "P").agg(F.sum("weight").alias("dgr")).unionByName(
        own.groupBy("P").agg(F.sum("weight").alias("dgr")).select(total, "P", "dgr"))
    among = _among(edges, members)
    everyone = panel_bib.select(F.col("com").cast("string").alias("com"), "P").unionByName(panel_bib.select(total, "P").distinct())
    base = (
        everyone.join(n_all.withColumnRenamed("N", "N_all"), "P").join(n, ["com", "P"], "left")
        .join(g, ["com", "P"], "left").join(among, ["com", "P"], "left").join(dgr, ["com", "P"], "left")
    )
    whole = F.col("com") == ALL
    base = base.withColumns({"n": F.when(whole, F.col("N_all")).otherwise(F.col("n")), "dgr": F.coalesce("dgr", F.lit(0.0))})
    out = _index(base, "_g", "div_ext")
    coh = ratio("dgr", F.col("N_all") * (F.col("N_all") - 1))
    return out.select("com", "P", F.coalesce(coh, F.lit(0.0)).alias("coh_ext"), "div_ext", F.col("N_all").alias("N_coms"), "n", "dgr", "V", "B", "D")
