"""Building and selecting a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citespark.functions.pairs import dealt
from citespark.functions import (
    numbered, occurrence_numbers, ordered_histogram, percent_ranks, scalar_quantile, tc_per_year, top_per_group,
)


def cap_per_batch(df: DataFrame, n_max: int, batch: str = "batch", pos: str = "XX") -> DataFrame:
    """First ``n_max`` rows of each batch by position, rows without one last."""
    return occurrence_numbers(df, [batch], pos, "_n").where(F.col("_n") <= n_max).drop("_n")


def first_wins_dedupe(df: DataFrame, key: str = "XX", batch: str = "batch", pos: str | None = None) -> DataFrame:
    """First occurrence of each key, batches in order."""
    order = [F.col(batch)] + ([F.col(pos)] if pos else [])
    return top_per_group(df, [key], order, 1)


def ingest_report(df: DataFrame, key: str = "XX", batch: str = "batch") -> DataFrame:
    """Per batch: rows loaded, keys newly added, running corpus size."""
    loaded = df.groupBy(batch).agg(F.count(F.lit(1)).alias("loaded"))
    first = df.groupBy(key).agg(F.min(batch).alias(batch)).groupBy(batch).agg(F.count(F.lit(1)).alias("added"))
    out = loaded.join(first, batch, "left").withColumn("added", F.coalesce("added", F.lit(0).cast("long")))
    # one row per batch file
    return out.withColumn("total", F.sum("added").over(Window.partitionBy(F.lit(0)).orderBy(batch)))


def corpus_saturation(df: DataFrame, key: str = "XX", batch: str = "batch") -> DataFrame:
    """Unique publications per batch and the running size of the corpus."""
    rep = ingest_report(df.select(key, batch).distinct(), key, batch)
    return rep.select(batch, F.col("added").alias("n"), F.col("total").alias("n_cum"))


def unique_keys(df: DataFrame, key: str = "XX", order: str = "pos") -> DataFrame:
    """Repeated keys become ``k``, ``k_1``, ``k_2``, in the order of an integer column."""
    out = occurrence_numbers(df, [key], order, "_n")
    k = F.col(key).cast("string")
    return out.withColumn(
        key, F.when(F.col("_n") == 1, k).otherwise(F.concat(k, F.lit("_"), (F.col("_n") - 1).cast("string")))
    ).drop("_n")


def exclude_values(df: DataFrame, pairs: Sequence[tuple[str, object]]) -> DataFrame:
    """Drop rows with ``col == value`` for each pair; rows with a null there go too."""
    for name, value in pairs:
        df = df.where(F.col(name) != value)
    return df


def range_filter(
    df: DataFrame, tc_min: float = 0, py_min: int | None = None, py_max: int | None = None,
    tc_year_min: float | None = None, doc_types: Sequence[str] | None = None,
) -> DataFrame:
    out = df.where(F.col("TC") >= tc_min)
    if py_min is not None:
        out = out.where(F.col("PY") >= py_min)
    if py_max is not None:
        out = out.where(F.col("PY") <= py_max)
    if tc_year_min is not None:
        out = out.where(F.col("TC_year") >= tc_year_min)
    if doc_types is not None:
        out = out.where(F.col("DT").isin(list(doc_types)))
    return out


def quality_filter(
    df: DataFrame, tc_min: int = 10, tc_year_min: float = 5, years: tuple[int, int] = (1990, 2018),
    refs: tuple[int, int] = (10, 300), not_types: Sequence[str] = (),
) -> DataFrame:
    """Cited often enough in total or per year, in the year and reference ranges, of a kept type."""
    out = df.where((F.col("TC") >= tc_min) | (F.col("TC_year") >= tc_year_min))
    out = out.where(F.col("PY").between(*years) & F.col("NR").between(*refs))
    return out.where(~F.col("DT").isin(list(not_types))) if not_types else out


def quantile_or_filter(df: DataFrame, columns: Sequence[str] = ("TC", "TC_year"), p: float = 0.5) -> DataFrame:
    """Rows at or above the p-quantile of any of the columns."""
    cond = F.lit(False)
    for name in columns:
        cond = cond | (F.col(name) >= scalar_quantile(df, name, p))
    return df.where(cond)


def top_cited_export(df: DataFrame, by: str = "TC", n: int = 100, key: str = "XX") -> DataFrame:
    """Top n with rank percentiles (mean rank for ties, over all rows) of TC and TC per year."""
    top = df.orderBy(F.col(by).desc_nulls_last(), F.col(key)).limit(n)
    for name, out in (("TC", "percentile_TC"), ("TC_year", "percentile_TCyear")):
        mean_rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
        places = ordered_histogram(df, name).select(name, F.round(mean_rank / F.col("total"), 2).alias(out))
        top = top.join(places, name, "left")
    return top


def seed_selection(df: DataFrame, share: float = 0.01, years: Sequence[int] = (), top: int = 3, key: str = "XX") -> DataFrame:
    """Top cited overall, top cited per year, and the ``top`` most cited of given years; distinct keys."""
    overall = percent_ranks(df.select(key, "TC"), "TC", name="_p").where(F.col("_p") >= 1 - share).select(key)
    yearly = percent_ranks(df.select(key, "PY", "TC"), "TC", ["PY"], "_p").where(F.col("_p") >= 1 - share).select(key)
    out = overall.unionByName(yearly)
    if years:
        lead = top_per_group(df.where(F.col("PY").isin(list(years))), ["PY"], [F.col("TC").desc_nulls_last(), F.col(key)], top)
        out = out.unionByName(lead.select(key))
    return out.distinct()


def expand_from_seeds(seeds: DataFrame, cites: DataFrame, k: int = 1000, pub: str = "EID", ref: str = "SID") -> DataFrame:
    """For each ``seeds(seed)`` the k publications sharing most references with it.

    A reference may have very many seeds and citers: both sides are dealt over blocks, so that no join key holds more
    than about ``BLOCK`` rows of either.
    """
    cites = cites.select(pub, ref).distinct()
    wanted = cites.join(seeds.select(F.col("seed").alias(pub)), pub, "left_semi").select(F.col(pub).alias("seed"), ref)
    wanted, cites = dealt(wanted, cites, ref, "seed", pub)
    shared = (
        wanted.join(cites, [ref, "_l", "_r"]).where(F.col(pub) != F.col("seed"))
        .groupBy("seed", pub).agg(F.count(F.lit(1)).alias("shared"))
    )
    return top_per_group(shared, ["seed"], [F.desc("shared"), F.col(pub)], k, name="rank")


def seed_list(df: DataFrame, as_of_year: int, key: str = "XX", width: int = 100) -> DataFrame:
    """Numbered seed table, most cited per year first."""
    from citespark.functions import truncate_text
    out = df.withColumn("TC_year", F.round(tc_per_year("TC", "PY", as_of_year), 2))
    out = numbered(out, "TC_year", key, "no")
    return out.select("no", key, "PY", truncate_text("TI", width).alias("TI"), "SO", "TC", "TC_year")


def restrict_to_network(pubs: DataFrame, nodes: DataFrame, key: str = "XX") -> DataFrame:
    return pubs.join(nodes.select(F.col("id").alias(key)), key, "left_semi")


def merge_network_labels(pubs: DataFrame, labels: DataFrame, how: str = "inner", key: str = "XX") -> DataFrame:
    """Attach labels; the first label row of a key wins."""
    one = labels.withColumnRenamed("id", key)
    one = top_per_group(one, [key], [F.col(c) for c in one.columns if c != key], 1)
    return pubs.join(one, key, how)


def label_lookup(df: DataFrame, names: DataFrame, on: str = "com") -> DataFrame:
    """Readable names for community ids; unknown ids stay without a name."""
    return df.join(names, on, "left")
