"""Time series with shares, complete panels and keyword themes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citespark.functions import period_of, ratio
from citespark.functions.columns import PERIOD_BOUNDS

# Themes as alternatives of patterns that must all occur in the lower-cased text.
THEMES: dict[str, list[list[str]]] = {
    "Theory": [["theor.*|concept|framework", "improv.*|develop.*"]],
    "Governance": [["transition management|governance"]],
    "Politics": [["polit.*|power"]],
    "Geography": [["urban.*|spatial|city|cities|geograph.*"]],
    "Business": [["firm|industr.*|actor|organization|sector", "strateg.*|business"]],
    "Social": [["social movement|communit.*|grassroot|civil society"]],
    "Practices": [["consumption", "practice"], ["practice theory|everyday"]],
    "Ethics": [["ethic.*|justice|poverty"]],
}


def with_share(df: DataFrame, t: str, value: str, share: str = "share") -> DataFrame:
    """Share of each row in the total of its time step."""
    total = F.sum(value).over(Window.partitionBy(t))  # rows per step = categories
    return df.withColumn(share, ratio(value, total))


def series_with_share(
    df: DataFrame, t: str, by: str, value: str | None = None, agg: str = "count",
    t_min: int | None = None, t_max: int | None = None, name: str = "n", share: str = "n_rel",
) -> DataFrame:
    """Value per (t, by) and its share of the total at t, in a range of t."""
    how = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "mean": F.avg}[agg]
    if t_min is not None:
        df = df.where(F.col(t) >= t_min)
    if t_max is not None:
        df = df.where(F.col(t) <= t_max)
    return with_share(df.groupBy(t, by).agg(how(value).alias(name)), t, name, share)


def topics_over_time(gamma: DataFrame, pubs: DataFrame, agg: str = "sum", select_com: Sequence | None = None, key: str = "EID") -> DataFrame:
    """Topic weight per year, summed or averaged, and its share."""
    if select_com is not None:
        pubs = pubs.where(F.col("com").isin(list(select_com)))
    rows = gamma.join(pubs.select(F.col(key).alias("document"), "PY"), "document")
    return series_with_share(rows, "PY", "topic", "gamma", agg, name="weight", share="weight_rel")


def knowledge_base_over_time(edges_2m: DataFrame, pubs: DataFrame, select_com: Sequence | None = None, key: str = "XX") -> DataFrame:
    """Citations received per citing year and cited community; rows without label drop out first."""
    if select_com is not None:
        edges_2m = edges_2m.where(F.col("com_bib").isin(list(select_com)))
    rows = edges_2m.join(pubs.select(F.col(key).alias("from"), "PY"), "from").dropna(subset=["PY", "com_cit"])
    return series_with_share(rows, "PY", "com_cit", name="TC", share="TC_rel")


def timeline_prepare(
    series: DataFrame, t: str, y1: str, y2: str, by: str, select_cat: Sequence | None = None,
    t_min: int | None = None, t_max: int | None = None,
) -> DataFrame:
    """Rows of a time line, with the label position of each category at the last time step.

    The position is the middle of the category's band when the bands are stacked from the
    last category to the first; null at all other time steps.
    """
    out = series
    if select_cat is not None:
        out = out.where(F.col(by).isin(list(select_cat)))
    if t_min is not None:
        out = out.where(F.col(t) >= t_min)
    if t_max is not None:
        out = out.where(F.col(t) <= t_max)
    out = out.select(t, y1, y2, by)
    last = out.agg(F.max(t)).scalar()
    stack = Window.partitionBy(t).orderBy(F.col(by).desc())
    pos = F.sum(y2).over(stack) - F.col(y2) / 2
    return out.withColumn("pos", F.when(F.col(t) == last, pos))


# panels -------------------------------------------------------------------------
def complete_grid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All combinations of the values of some low-cardinality columns (communities, years, periods)."""
    first, *rest = columns
    out = df.select(first).dropna().distinct()
    for name in rest:
        values = df.select(name).dropna().distinct().agg(F.sort_array(F.collect_set(name))).scalar()
        out = out.select("*", values.alias("_vals")).select("*", F.explode("_vals").alias(name)).drop("_vals")
    return out


def panel(nodes: DataFrame, t: str = "PY", by: str = "com", sums: Sequence[str] = ("TC", "NR", "dgr", "dgr_int")) -> DataFrame:
    """Complete (community x t) table of counts and sums, zero-filled, with running totals.

    ``dgr_ext`` is the degree leaving the community, ``dgr_ratio`` the cumulative internal share.
    """
    per = nodes.groupBy(by, t).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    full = complete_grid(per, [by, t]).join(per, [by, t], "left")
    kinds = dict(per.dtypes)
    full = full.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(kinds[c])) for c in ["n", *sums]})
    full = full.withColumn("dgr_ext", F.col("dgr") - F.col("dgr_int"))
    full = full.withColumns({c: F.round(c, 2) for c in ("dgr", "dgr_int", "dgr_ext")})
    run = Window.partitionBy(by).orderBy(t)
    values = ["n", *sums, "dgr_ext"]
    full = full.withColumns({f"{c}_cum": F.sum(c).over(run) for c in values})
    return full.withColumn("dgr_ratio", F.round(F.coalesce(ratio("dgr_int_cum", "dgr_cum"), F.lit(0.0)), 2))


def community_year_panel(nodes: DataFrame, t_min: int | None = None, t_max: int | None = None, bounds: Sequence[int] = PERIOD_BOUNDS, sums: Sequence[str] = ("TC", "NR", "dgr", "dgr_int")) -> DataFrame:
    """Yearly panel; the year range cuts after the running totals are taken."""
    out = panel(nodes, "PY", sums=sums)
    if t_min is not None:
        out = out.where(F.col("PY") >= t_min)
    if t_max is not None:
        out = out.where(F.col("PY") <= t_max)
    return out.withColumn("P", period_of("PY", bounds))


def community_period_panel(nodes: DataFrame, bounds: Sequence[int] = PERIOD_BOUNDS, sums: Sequence[str] = ("TC", "NR", "dgr", "dgr_int")) -> DataFrame:
    with_p = nodes.withColumn("P", period_of("PY", bounds)).where(F.col("P").isNotNull())
    return panel(with_p, "P", sums=sums)


# keyword themes ------------------------------------------------------------------
def _theme(text: Column, alternatives: Sequence[Sequence[str]]) -> Column:
    out = F.lit(False)
    for patterns in alternatives:
        hit = F.lit(True)
        for p in patterns:
            hit = hit & text.rlike(p)
        out = out | hit
    return out


def keyword_flags(df: DataFrame, text: str, themes: Mapping[str, Sequence[Sequence[str]]] = THEMES) -> DataFrame:
    """One boolean column per theme, from patterns on the lower-cased text."""
    low = F.lower(text)
    return df.withColumns({name: _theme(low, alt) for name, alt in themes.items()}).drop(text)


def keyword_series(flags: DataFrame, themes: Sequence[str], t: str = "PY") -> DataFrame:
    """Documents per year and theme, and the share within the year."""
    counts = flags.groupBy(t).agg(*[F.count_if(F.col(c)).alias(c) for c in themes])
    return with_share(counts.unpivot(t, list(themes), "content", "n"), t, "n", "n_rel")
