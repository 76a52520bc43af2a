"""Citation networks as edge tables ``(src, dst, weight)`` with ``src < dst`` and node tables ``(id, …)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions import (
    ordered_histogram, percent_ranks, quantiles, ratio, scalar_quantile, shared_item_pairs, top_per_group,
)


# building ---------------------------------------------------------------------
def incidence(cites: DataFrame, pub: str = "EID", ref: str = "SID") -> DataFrame:
    """0/1 incidence as distinct (publication, reference) rows."""
    return cites.select(pub, ref).dropna().distinct()


def bib_coupling(cites: DataFrame, pub: str = "EID", ref: str = "SID", min_weight: int = 1) -> DataFrame:
    """Publication pairs with the number of shared references.

    ``min_weight`` fuses the usual edge cut into the join: the result is that of
    ``edge_weight_cut(bib_coupling(cites), k)``, without the pairs below the cut.
    """
    return shared_item_pairs(cites, pub, ref, min_weight)


def co_citation(cites: DataFrame, pub: str = "EID", ref: str = "SID", min_weight: int = 1) -> DataFrame:
    """Reference pairs with the number of publications citing both."""
    return shared_item_pairs(cites, ref, pub, min_weight)


def simplify_graph(edges: DataFrame, how: str = "sum") -> DataFrame:
    """Undirected edges without loops; parallel edges merged by ``sum`` or ``max``."""
    merge = {"sum": F.sum, "max": F.max}[how]
    return (
        edges.where(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(merge("weight").alias("weight"))
    )


def direct_citation_network(cites: DataFrame, pubs: DataFrame, pub: str = "EID", ref: str = "SID", key: str = "XX", year: str = "PY") -> DataFrame:
    """Distinct citing->cited edges inside the corpus, the cited work being older."""
    years = pubs.select(F.col(key).alias("_k"), F.col(year).alias("_y"))
    return (
        cites.select(F.col(pub).alias("src"), F.col(ref).alias("dst"))
        .join(years.withColumnsRenamed({"_k": "dst", "_y": "dst_year"}), "dst")
        .join(years.withColumnsRenamed({"_k": "src", "_y": "src_year"}), "src")
        .where(F.col("dst_year") < F.col("src_year"))
        .select("src", "dst", "src_year", "dst_year")
        .distinct()
    )


def historiograph_top(direct: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """Papers cited locally at least as often as the n-th, and the edges among them."""
    score = direct.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("lcs"))
    nth = score.orderBy(F.desc("lcs")).limit(n).agg(F.min("lcs")).scalar()
    nodes = score.where(F.col("lcs") >= nth)
    keep = nodes.select("id")
    return nodes, induced_edges(direct.select("src", "dst"), keep)


# attributes -------------------------------------------------------------------
def edge_ends(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Each undirected edge seen from both ends: ``(id, other, weight)``."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("other")),
    )
    return edges.select(F.explode(ends).alias("_e"), F.col(weight).alias("weight")).select("_e.*", "weight")


def weighted_degree(edges: DataFrame, nodes: DataFrame | None = None, weight: str = "weight", name: str = "dgr") -> DataFrame:
    """Strength of each node; with ``nodes(id, …)`` isolated nodes get 0."""
    dgr = edge_ends(edges, weight).groupBy("id").agg(F.sum("weight").cast("double").alias(name))
    if nodes is None:
        return dgr
    return nodes.join(dgr, "id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def attach_to_ends(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], key: str = "id", suffixes: tuple[str, str] = ("_i", "_j"), how: str = "inner") -> DataFrame:
    """Node attributes on both ends of each edge (``com`` becomes ``com_i`` and ``com_j``)."""
    out = edges
    for end, suffix in zip(("src", "dst"), suffixes):
        look = nodes.select(F.col(key).alias(end), *[F.col(c).alias(c + suffix) for c in columns])
        out = out.join(look, end, how)
    return out


def join_node_attributes(nodes: DataFrame, pubs: DataFrame, key: str = "XX") -> DataFrame:
    return nodes.join(pubs.withColumnRenamed(key, "id"), "id", "left")


# normalising ------------------------------------------------------------------
def _jaccard(df: DataFrame, i: str, j: str, weight: str = "weight") -> F.Column:
    return ratio(F.col(weight), F.col(i) + F.col(j) - F.col(weight))


def coupling_jaccard(edges: DataFrame, pubs: DataFrame, key: str = "XX", nr: str = "NR", digits: int = 3) -> DataFrame:
    """Shared references over the union of both reference lists."""
    out = attach_to_ends(edges, pubs, [nr], key)
    return out.select(
        "src", "dst", F.col("weight").alias("weight_count"),
        F.round(_jaccard(out, nr + "_i", nr + "_j"), digits).alias("weight"),
    )


def degree_jaccard(edges: DataFrame, nodes: DataFrame | None = None, degree_scope: str = "pre") -> DataFrame:
    """``weight_jac`` from weighted degrees.

    ``pre``: degrees as given in ``nodes(id, dgr)``, i.e. taken before a node filter;
    ``post``: degrees of the edges at hand.
    """
    if degree_scope == "post" or nodes is None:
        nodes = weighted_degree(edges)
    out = attach_to_ends(edges, nodes, ["dgr"])
    return out.select("src", "dst", "weight", _jaccard(out, "dgr_i", "dgr_j").alias("weight_jac"))


def pairwise_jaccard(df: DataFrame, i: str, j: str, w: str, by: Sequence[str] = (), name: str = "weight_jac") -> DataFrame:
    """``w / (sum_i w + sum_j w - w)``, the sums taken inside the groups ``by``."""
    by = list(by)
    wi = df.groupBy(*by, i).agg(F.sum(w).alias("_wi"))
    wj = df.groupBy(*by, j).agg(F.sum(w).alias("_wj"))
    out = df.join(wi, [*by, i]).join(wj, [*by, j])
    return out.withColumn(name, _jaccard(out, "_wi", "_wj", w)).select(*df.columns, name)


def min_max_norm(df: DataFrame, value: str, name: str | None = None) -> DataFrame:
    """``(x - min) / (max - min)``; nulls stay null."""
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("r")).scalar()
    x = F.col(value).cast("double")
    return df.withColumn(name or value, F.try_divide(x - ends["lo"], (ends["hi"] - ends["lo"]).cast("double")))


def cocit_minmax(edges: DataFrame, digits: int = 3) -> DataFrame:
    """Min-max normalised co-citation weight, positive edges only."""
    out = min_max_norm(edges, "weight", "_n")
    return out.select(
        "src", "dst", F.col("weight").alias("weight_count"), F.round("_n", digits).alias("weight")
    ).where(F.col("weight") > 0)


def association_strength(edges: DataFrame, cites: DataFrame, member: str = "EID") -> DataFrame:
    """``s_ij / (s_i * s_j)`` with ``s`` = items held by the member in the incidence."""
    size = cites.groupBy(F.col(member).alias("id")).agg(F.count(F.lit(1)).alias("s"))
    out = attach_to_ends(edges, size, ["s"])
    return out.select("src", "dst", "weight", ratio(F.col("weight"), F.col("s_i") * F.col("s_j")).alias("assoc"))


# pruning ----------------------------------------------------------------------
def edge_weight_cut(edges: DataFrame, k: float, weight: str = "weight") -> DataFrame:
    return edges.where(F.col(weight) >= k)


def edge_quantile_cut(edges: DataFrame, p: float, strict: bool = True, weight: str = "weight") -> DataFrame:
    cut = scalar_quantile(edges, weight, p)
    return edges.where(F.col(weight) > cut if strict else F.col(weight) >= cut)


def drop_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edge_ends(edges.withColumn("weight", F.lit(1))).select("id"), "id", "left_semi")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both in ``nodes(id)``."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return out


def node_percent_rank_cut(nodes: DataFrame, edges: DataFrame, p: float = 0.10, degree: str = "dgr") -> tuple[DataFrame, DataFrame]:
    kept = percent_ranks(nodes, degree, name="_pr").where(F.col("_pr") >= p).drop("_pr").select(nodes.columns)
    return kept, induced_edges(edges, kept)


def node_degree_cut(nodes: DataFrame, edges: DataFrame, k: float | None = None, p: float | None = None, degree: str = "dgr") -> tuple[DataFrame, DataFrame]:
    """Nodes with degree ``>= k``, or above the p-quantile, with the induced edges."""
    kept = nodes.where(F.col(degree) >= k if k is not None else F.col(degree) > scalar_quantile(nodes, degree, p))
    return kept, induced_edges(edges, kept)


# communities given as labels ----------------------------------------------------
def internal_degree(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``dgr``, ``dgr_int`` (same ``com``) and, with ``com2``, ``dgr_int2`` (same ``com`` and ``com2``)."""
    levels = [c for c in ("com", "com2") if c in labels.columns]
    ends = attach_to_ends(edges, labels, levels)
    same = F.col("com_i") == F.col("com_j")
    w = F.col("weight").cast("double")
    cols = {"dgr": w, "dgr_int": F.when(same, w)}
    if "com2" in levels:
        cols["dgr_int2"] = F.when(same & (F.col("com2_i") == F.col("com2_j")), w)
    long = ends.select(F.explode(F.array("src", "dst")).alias("id"), *[c.alias(n) for n, c in cols.items()])
    dgr = long.groupBy("id").agg(*[F.sum(n).alias(n) for n in cols])
    return labels.join(dgr, "id", "left").select(
        *labels.columns, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in cols]
    )


def external_degree(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("dgr_ext", F.col("dgr") - F.col("dgr_int"))


def community_size_filter(labels: DataFrame, edges: DataFrame, min_size: int, min_size2: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop nodes of small communities, blank small sub-communities, recompute the degree."""
    size = labels.groupBy("com").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    kept = labels.join(size.select("com"), "com", "left_semi")
    if min_size2 is not None:
        size2 = labels.groupBy("com", "com2").agg(F.count(F.lit(1)).alias("_n2"))
        kept = kept.join(size2, ["com", "com2"], "left").withColumn(
            "com2", F.when(F.col("_n2") >= min_size2, F.col("com2"))
        )
    kept = kept.select(*[c for c in labels.columns if c != "dgr"])
    inner = induced_edges(edges, kept)
    return weighted_degree(inner, kept), inner


def community_network(labels: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Community nodes with size ``N`` and summed undirected edges, loops included."""
    nodes = labels.groupBy("com").agg(F.count(F.lit(1)).alias("N"))
    ends = attach_to_ends(edges, labels, ["com"])
    agg = ends.groupBy(
        F.least("com_i", "com_j").alias("src"), F.greatest("com_i", "com_j").alias("dst")
    ).agg(F.sum("weight").alias("weight"))
    return nodes, agg


def community_density_weight(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge weight per possible pair in percent, and node strength (a loop counts twice)."""
    sized = attach_to_ends(edges, nodes, ["N"], key="com")
    dense = sized.select(
        "src", "dst", F.col("weight").alias("weight_count"),
        F.round(ratio(F.col("weight"), F.col("N_i") * F.col("N_j")) * 100, 4).alias("weight"),
    )
    dgr = weighted_degree(dense, nodes.withColumnRenamed("com", "id"))
    return dgr.withColumnRenamed("id", "com"), dense


def community_network_view(edges: DataFrame, p: float = 0.25) -> DataFrame:
    """What is drawn: no loops, positive, the upper 75 % of edges."""
    return edge_quantile_cut(edges.where((F.col("src") != F.col("dst")) & (F.col("weight") > 0)), p, strict=False)


def two_mode_edges(cites: DataFrame, labels_bib: DataFrame, labels_cit: DataFrame, pub: str = "EID", ref: str = "SID") -> DataFrame:
    """Article->reference edges with both community labels."""
    return (
        cites.join(labels_bib.select(F.col("id").alias(pub), F.col("com").alias("com_bib")), pub)
        .join(labels_cit.select(F.col("id").alias(ref), F.col("com").alias("com_cit")), ref)
        .select(F.col(pub).alias("from"), F.col(ref).alias("to"), "com_bib", "com_cit")
    )


def ego_top_subgraph(nodes: DataFrame, edges: DataFrame, by: str = "com2", degree: str = "dgr_int2", n: int = 100, p: float = 0.75) -> DataFrame:
    """Per sub-community the top-n nodes, and their edges above the p-quantile of that subgraph."""
    top = top_per_group(nodes, [by], [F.col(degree).desc_nulls_last(), F.col("id")], n).select("id", by)
    inner = attach_to_ends(edges, top, [by]).where(F.col(by + "_i") == F.col(by + "_j"))
    inner = inner.select(F.col(by + "_i").alias(by), "src", "dst", "weight")
    cut = quantiles(inner, "weight", p, [by], "_q")
    return inner.join(cut, by).where(F.col("weight") >= F.col("_q")).drop("_q")


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``Q = sum_c(w_in/m - (deg/2m)^2)`` as a one-row table (modularity, m)."""
    ends = attach_to_ends(edges, labels, ["com"])
    halves = ends.select(
        F.explode(F.array("com_i", "com_j")).alias("com"),
        F.col("weight").cast("double").alias("w"),
        (F.col("com_i") == F.col("com_j")).alias("inside"),
    )
    per = halves.groupBy("com").agg(
        F.sum("w").alias("deg"), F.sum(F.when(F.col("inside"), F.col("w") / 2).otherwise(0.0)).alias("w_in")
    )
    # all sums in one pass: Q = W_in/m - sum(deg^2)/(4 m^2)
    tot = per.agg(F.sum("w_in").alias("w_in"), F.sum("deg").alias("d"), F.sum(F.col("deg") * F.col("deg")).alias("d2"))
    m = F.col("d") / 2
    return tot.select(
        (F.try_divide(F.col("w_in"), m) - F.try_divide(F.col("d2"), F.lit(4.0) * m * m)).alias("modularity"), m.alias("m")
    )


def merge_node_universe(names: DataFrame, nodes: DataFrame, strength: str = "dgr", by: Sequence[str] = ()) -> DataFrame:
    """All names, missing ones isolated; size = strength / largest strength (0 for isolated)."""
    by = list(by)
    top = nodes.groupBy(*by).agg(F.max(strength).alias("_top"))
    if by:
        sized = nodes.join(top, by)
        sized = sized.select("id", *by, strength, ratio(strength, "_top").alias("size"))
    else:
        sized = nodes.select("id", strength, ratio(F.col(strength), top.scalar()).alias("size"))
    out = names.join(sized, ["id", *by], "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (strength, "size")})


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("F", "DataFrame", "Sequence", "annotations")]
