"""Bibliometric indicators, rankings and side-by-side summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citespark.functions import clean_author, numbered, ratio, scalar_quantile, tc_per_year, top_per_group, truncate_text  # noqa: F401

# Sums of doubles depend on the order in which partitions arrive; rankings use them rounded to this.
STABLE_DIGITS = 9


def _stable_sum(c: Column | str) -> Column:
    return F.round(F.sum(c), STABLE_DIGITS)


def _top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


# whole corpus -------------------------------------------------------------------
def main_info(pubs: DataFrame, authors: DataFrame, cites: DataFrame, as_of_year: int, key: str = "XX", child_key: str = "EID", ref: str = "SID") -> DataFrame:
    """Key figures of the corpus as (indicator, value)."""
    p = pubs.withColumn("_ty", tc_per_year("TC", "PY", as_of_year)).agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("SO").alias("sources"),
        F.min("PY").alias("first_year"), F.max("PY").alias("last_year"), F.avg("TC").alias("mean_tc"),
        F.avg("_ty").alias("mean_tc_year"), F.avg(F.lit(as_of_year) - F.col("PY")).alias("mean_age"),
    )
    per_doc = authors.groupBy(child_key).agg(F.count(F.lit(1)).alias("_n"))
    joined = authors.join(per_doc, child_key).groupBy("AU").agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.col("_n") > 1).alias("_multi"))
    a = joined.agg(F.struct(
        F.count(F.lit(1)).alias("authors"), F.sum("_rows").alias("appearances"),
        F.count_if("_multi").alias("multi_authors")).alias("r")).scalar()
    d = per_doc.agg(F.struct(
        F.count_if(F.col("_n") == 1).alias("single"), F.count_if(F.col("_n") > 1).alias("multi")).alias("r")).scalar()
    refs = cites.select(ref).distinct().agg(F.count(F.lit(1))).scalar()
    wide = p.withColumns({
        "references": refs, "authors": a["authors"], "appearances": a["appearances"],
        "single_authored_documents": d["single"], "documents_per_author": ratio("documents", a["authors"]),
        "authors_per_document": ratio(a["authors"], "documents"),
        "coauthors_per_document": ratio(a["appearances"], "documents"),
        "collaboration_index": ratio(a["multi_authors"], d["multi"]),
    })
    wide = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
    return wide.unpivot([], list(wide.columns), "indicator", "value")


def annual_production(pubs: DataFrame) -> DataFrame:
    """Documents per year and the compound yearly growth rate in percent."""
    per = pubs.groupBy("PY").agg(F.count(F.lit(1)).alias("n"))
    ends = per.agg(F.struct(
        F.min_by("n", "PY").alias("a"), F.max_by("n", "PY").alias("b"), (F.max("PY") - F.min("PY")).alias("steps")).alias("r")).scalar()
    growth = F.when(
        ends["steps"] > 0,
        (F.pow(ratio(ends["b"], ends["a"]), F.try_divide(F.lit(1.0), ends["steps"].cast("double"))) - 1) * 100)
    return per.withColumn("growth", growth)


def author_counts(authors: DataFrame, key: str = "EID") -> DataFrame:
    n = authors.groupBy(key).agg(F.count(F.lit(1)).alias("N_AU"))
    return authors.join(n, key).groupBy("AU").agg(
        F.count(F.lit(1)).alias("n"), _stable_sum(ratio(F.lit(1), "N_AU")).alias("n_frac"))


def top_authors(authors: DataFrame, k: int = 10, key: str = "EID") -> DataFrame:
    return _top(author_counts(authors, key), k, F.desc("n_frac"), F.col("AU"))


def top_cited_documents(pubs: DataFrame, as_of_year: int, k: int = 10, key: str = "XX") -> DataFrame:
    top = _top(pubs, k, F.desc_nulls_last("TC"), F.col(key))
    return top.withColumn("TC_year", tc_per_year("TC", "PY", as_of_year))


def first_country(countries: DataFrame, key: str = "EID") -> DataFrame:
    """Country of the first author and number of countries per document."""
    return countries.groupBy(key).agg(F.min_by("CN", "pos").alias("CN"), F.countDistinct("CN").alias("n_cn"))


def country_collaboration(countries: DataFrame, key: str = "EID") -> DataFrame:
    """Per first country: articles, share, single- and multi-country articles and their ratio."""
    docs = first_country(countries, key)
    per = docs.groupBy("CN").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_cn") == 1).alias("SCP"), F.count_if(F.col("n_cn") > 1).alias("MCP"))
    total = per.agg(F.sum("n")).scalar()
    return per.select("CN", "n", ratio("n", total).alias("Freq"), "SCP", "MCP", ratio("MCP", "n").alias("MCP_ratio"))


def country_citations(countries: DataFrame, pubs: DataFrame, key: str = "EID", pub: str = "XX") -> DataFrame:
    docs = first_country(countries, key).join(pubs.select(F.col(pub).alias(key), "TC"), key)
    return docs.groupBy("CN").agg(F.sum("TC").alias("TC"), F.avg("TC").alias("TC_mean"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent values of a column (sources, keywords)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return _top(counts, k, F.desc("n"), F.col(column))


def top_fractional(df: DataFrame, column: str, k: int = 10, key: str = "EID") -> DataFrame:
    """Fractional counts: each row of a document weighs one over its rows (institutions, countries)."""
    rows = df.where(F.col(column).isNotNull())
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counts = rows.join(n, key).groupBy(column).agg(_stable_sum(ratio(F.lit(1), "_n")).alias("n_frac"))
    return _top(counts, k, F.desc("n_frac"), F.col(column))


def citations_per_year(pubs: DataFrame, as_of_year: int) -> DataFrame:
    per = pubs.groupBy("PY").agg(F.avg("TC").alias("TC_mean"))
    return per.withColumn("TC_mean_year", tc_per_year("TC_mean", "PY", as_of_year))


def cited_references(cites: DataFrame, k: int | None = 20, ref: str = "SID") -> DataFrame:
    counts = cites.groupBy(ref).agg(F.count(F.lit(1)).alias("n"))
    return counts if k is None else _top(counts, k, F.desc("n"), F.col(ref))


def local_citations(direct: DataFrame, pubs: DataFrame, key: str = "XX") -> DataFrame:
    """Citations received inside the corpus (LCS) beside the global count (GCS)."""
    lcs = direct.groupBy(F.col("dst").alias(key)).agg(F.count(F.lit(1)).alias("LCS"))
    return pubs.select(key, "PY", F.col("TC").alias("GCS")).join(lcs, key)


def local_citations_by_author(local: DataFrame, authors: DataFrame, key: str = "XX", child_key: str = "EID") -> DataFrame:
    return authors.join(local.withColumnRenamed(key, child_key), child_key).groupBy("AU").agg(F.sum("LCS").alias("LCS"))


def historiograph_table(direct: DataFrame, pubs: DataFrame, key: str = "XX") -> DataFrame:
    """Every paper of the citation history with year, local and global score."""
    scores = direct.select(
        F.explode(F.array(
            F.struct(F.col("dst").alias(key), F.lit(1).cast("long").alias("c")),
            F.struct(F.col("src").alias(key), F.lit(0).cast("long").alias("c")))).alias("_e"),
    ).select("_e.*").groupBy(key).agg(F.sum("c").alias("LCS"))
    return scores.join(pubs.select(key, "PY", F.col("TC").alias("GCS")), key)


def three_field_links(left: DataFrame, middle: DataFrame, right: DataFrame, columns: Sequence[str], n: int = 20, key: str = "EID") -> DataFrame:
    """Links left->middle->right among the top-n items of three fields, counted in documents."""
    def best(df: DataFrame, c: str) -> DataFrame:
        rows = df.select(key, c).dropna().distinct()
        return rows.join(top_values(rows, c, n).select(c), c, "left_semi")

    a, b, c = columns
    rows = {a: best(left, a), b: best(middle, b), c: best(right, c)}

    def link(x: str, y: str) -> DataFrame:
        pairs = rows[x].join(rows[y], key).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
        return pairs.select(
            F.lit(f"{x}-{y}").alias("fields"), F.col(x).cast("string").alias("source"), F.col(y).cast("string").alias("target"), "n")

    return link(a, b).unionByName(link(b, c))


def author_production_over_time(authors: DataFrame, pubs: DataFrame, as_of_year: int, k: int = 10, key: str = "EID", pub: str = "XX") -> DataFrame:
    top = top_values(authors, "AU", k).select("AU")
    rows = authors.join(top, "AU", "left_semi").join(pubs.select(F.col(pub).alias(key), "PY", "TC"), key)
    return rows.groupBy("AU", "PY").agg(
        F.count(F.lit(1)).alias("n"), F.sum("TC").alias("TC"), F.sum(tc_per_year("TC", "PY", as_of_year)).alias("TC_year"))


def reference_year_spectroscopy(cited_years: DataFrame, year: str = "PY") -> DataFrame:
    """References per cited year, zero-filled, and the deviation from the median of five years."""
    per = cited_years.where(F.col(year).isNotNull()).groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    grid = per.agg(F.explode(F.sequence(F.min(year), F.max(year))).alias(year))
    full = grid.join(per, year, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    around = Window.partitionBy(F.lit(0)).orderBy(year).rowsBetween(-2, 2)  # one row per year
    return full.withColumn("deviation", F.col("n") - F.percentile("n", F.lit(0.5)).over(around))


# communities --------------------------------------------------------------------
def community_size_density(nodes: DataFrame, by: str = "com") -> DataFrame:
    """Members and internal density in percent: ``sum(dgr_int) / (n (n-1)) * 100``."""
    per = nodes.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("dgr_int").alias("_d"))
    return per.select(by, "n", F.round(ratio("_d", F.col("n") * (F.col("n") - 1)) * 100, 3).alias("density_int"))


def most_central(nodes: DataFrame, n: int = 10, by: str = "com", degree: str = "dgr_int") -> DataFrame:
    """Top members by internal degree, ties kept."""
    return top_per_group(nodes, [by], [F.col(degree).desc_nulls_last()], n, ties=True)


def central_and_cited(nodes: DataFrame, n: int = 10, by: str = "com") -> DataFrame:
    """Top members by the product of relative internal degree and relative citations."""
    top = nodes.groupBy(by).agg(F.max("dgr_int").alias("_d"), F.max("TC").alias("_t"))
    scored = nodes.join(top, by).withColumn("dgr_select", ratio("dgr_int", "_d") * ratio("TC", "_t"))
    return top_per_group(scored, [by], [F.col("dgr_select").desc_nulls_last()], n, ties=True).drop("_d", "_t")


def zoom_community(nodes: DataFrame, com, names: DataFrame | None = None) -> DataFrame:
    """One community, its sub-communities promoted to ``com``."""
    out = nodes.where((F.col("com") == com) & F.col("com2").isNotNull()).drop("com").withColumnRenamed("com2", "com")
    return out if names is None else out.join(names, "com", "left")


# side-by-side summaries -----------------------------------------------------------
def _ranked(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows with their place ``rn``: per group, or the n best of the whole table."""
    if by:
        return top_per_group(df, by, order, n, name="rn")
    return _top(df, n, *order).withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def side_by_side(lists: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Several top lists in one table, paired by place; shorter lists end in nulls."""
    return reduce(lambda a, b: a.join(b, [*by, "rn"], "full"), lists)


def _strength_list(rows: DataFrame, column: str, n: int, name: str, width: int | None = None, digits: int = 0) -> DataFrame:
    per = rows.where(F.col(column).isNotNull()).groupBy("com", column).agg(_stable_sum("dgr_int").alias(name))
    ranked = _ranked(per, n, [F.desc(name), F.col(column)], ["com"])
    text = truncate_text(column, width) if width else F.col(column)
    return ranked.select("com", "rn", text.alias(column), F.round(name, digits).alias(name))


def _fractional(rows: DataFrame, key: str, column: str, fraction: str) -> DataFrame:
    """``reference``: share among equal (document, item) rows; ``true``: share among all rows of the document."""
    by = [key, column] if fraction == "reference" else [key]
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(n, by).withColumn("dgr_int", ratio("dgr_int", "_n")).drop("_n")


def pub_summary_general(
    pubs: DataFrame, authors: DataFrame, institutions: DataFrame, keywords: DataFrame, references: DataFrame,
    top_n: int = 10, fraction: str = "reference", key: str = "XX", child_key: str = "EID",
) -> DataFrame:
    """Per community: authors, journals, institutions, keywords by internal degree; references by count.

    ``references(child_key, CR)`` holds the label of each cited work.
    """
    core = pubs.select(F.col(key).alias(child_key), "com", "dgr_int")
    au = _fractional(authors.withColumn("AU", clean_author("AU")).join(core, child_key), child_key, "AU", fraction)
    c1 = _fractional(institutions.join(core, child_key), child_key, "C1", fraction)
    cr = references.join(core, child_key).groupBy("com", "CR").agg(F.count(F.lit(1)).alias("CR_n"))
    lists = [
        _strength_list(au, "AU", top_n, "AU_dgr"),
        _strength_list(pubs, "SO", top_n, "SO_dgr", 45),
        _strength_list(c1, "C1", top_n, "C1_dgr", 45),
        _strength_list(keywords.join(core, child_key), "DE", top_n, "DE_dgr"),
        _ranked(cr.where(F.col("CR").isNotNull()), top_n, [F.desc("CR_n"), F.col("CR")], ["com"]),
    ]
    return side_by_side(lists, ["com"])


def pub_summary_top(pubs: DataFrame, top_n: int = 10, key: str = "XX") -> DataFrame:
    """Most central publications per community."""
    top = _ranked(pubs, top_n, [F.desc_nulls_last("dgr_int"), F.col(key)], ["com"])
    return top.withColumns({"TI": truncate_text("TI", 150), "SO": truncate_text("SO", 45)})


def pub_summary_count(pubs: DataFrame, authors: DataFrame, institutions: DataFrame, countries: DataFrame, keywords: DataFrame, top_n: int = 10, digits: int = 0) -> DataFrame:
    """Authors, journals, institutions, countries and keywords of the corpus by (fractional) count."""
    def place(df: DataFrame, column: str, value: str, name: str) -> DataFrame:
        ranked = _ranked(df, top_n, [F.desc(value), F.col(column)])
        return ranked.select("rn", column, F.round(value, digits).alias(name))

    lists = [
        place(top_authors(authors, top_n).select("AU", "n_frac"), "AU", "n_frac", "AU_frac"),
        place(top_values(pubs, "SO", top_n), "SO", "n", "SO_n").withColumn("SO", truncate_text("SO", 45)),
        place(top_fractional(institutions, "C1", top_n), "C1", "n_frac", "C1_frac"),
        place(top_fractional(countries, "C1_CN", top_n), "C1_CN", "n_frac", "C1_CN_frac"),
        place(top_values(keywords, "DE", top_n), "DE", "n", "DE_n"),
    ]
    return side_by_side(lists)


def ref_summary_count(refs: DataFrame, authors: DataFrame, top_n: int = 10, digits: int = 0, key: str = "SID") -> DataFrame:
    """Cited authors, cited journals and references by citations."""
    n = authors.groupBy(key).agg(F.count(F.lit(1)).alias("N_AU"))
    au = authors.join(refs.select(key, "TC"), key).join(n, key).groupBy("AU").agg(
        _stable_sum(ratio("TC", "N_AU")).alias("AU_TC_frac"), _stable_sum(ratio(F.lit(1), "N_AU")).alias("AU_n_frac"),
        F.avg("TC").alias("AU_TC_n"))
    au = _ranked(au, top_n, [F.desc("AU_TC_frac"), F.col("AU")])
    so = refs.where(F.col("SO").isNotNull()).groupBy("SO").agg(
        F.sum("TC").alias("SO_TC"), F.count(F.lit(1)).alias("SO_n"), F.avg("TC").alias("SO_TC_n"))
    so = _ranked(so, top_n, [F.desc("SO_TC"), F.col("SO")]).withColumn("SO", truncate_text("SO", 35))
    sr = refs.where(F.col("SR").isNotNull()).select("SR", F.col("TC").alias("SR_TC"), F.col(key).alias("_k"))
    sr = _ranked(sr, top_n, [F.desc("SR_TC"), F.col("_k")]).drop("_k")
    rounded = {c: F.round(c, digits) for c in ("AU_TC_frac", "AU_n_frac", "AU_TC_n", "SO_TC_n")}
    return side_by_side([au, so, sr]).withColumns(rounded)


def ref_summary_general(refs: DataFrame, authors: DataFrame, top_n: int = 10, fraction: str = "reference", key: str = "SID") -> DataFrame:
    """Per community: cited authors, journals and references by internal degree."""
    core = refs.select(key, "com", "dgr_int")
    au = _fractional(authors.withColumn("AU", clean_author("AU")).join(core, key), key, "AU", fraction)
    sr = refs.where(F.col("SR").isNotNull()).select("com", "SR", F.round("dgr_int", 0).alias("SR_dgr"), F.col(key).alias("_k"))
    lists = [
        _strength_list(au, "AU", top_n, "AU_dgr"),
        _strength_list(refs, "SO", top_n, "SO_dgr", 45),
        _ranked(sr, top_n, [F.desc("SR_dgr"), F.col("_k")], ["com"]).drop("_k"),
    ]
    return side_by_side(lists, ["com"])


def gen_summary(tables: dict[str, DataFrame], level: str, what: str = "general", top_n: int = 10, select_com: Sequence | None = None) -> DataFrame:
    """Dispatch to the summaries.

    ``tables``: ``pubs, authors, institutions, countries, keywords, references`` for level PUB,
    ``refs, authors`` for level REF. ``select_com`` keeps some communities of the main table.
    """
    main_key = {"PUB": ("pubs", "XX", "EID"), "REF": ("refs", "SID", "SID")}.get(level)
    if main_key is None:
        raise ValueError("level must be 'REF' (references) or 'PUB' (publications)")
    name, key, child_key = main_key
    main = tables[name]
    children = {k: v for k, v in tables.items() if k != name}
    if select_com is not None:
        main = main.where(F.col("com").isin(list(select_com)))
        keep = main.select(F.col(key).alias(child_key))
        children = {k: v.join(keep, child_key, "left_semi") for k, v in children.items()}
    if level == "REF":
        if what == "count":
            return ref_summary_count(main, children["authors"], top_n)
        if what == "general":
            return ref_summary_general(main, children["authors"], top_n)
    else:
        if what == "count":
            return pub_summary_count(
                main, children["authors"], children["institutions"], children["countries"], children["keywords"], top_n)
        if what == "top":
            return pub_summary_top(main, top_n)
        if what == "general":
            return pub_summary_general(
                main, children["authors"], children["institutions"], children["keywords"], children["references"], top_n)
    raise ValueError(f"no summary {what!r} for level {level}")
