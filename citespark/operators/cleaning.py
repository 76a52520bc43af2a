"""Cleaning, normalising and shaping of publication tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions import (
    clean_author, first_author_label, nest, normalize_missing, ratio, short_reference, split_field, squish,
    strip_trailing_sep, tc_per_year, top_per_group,
)
from citespark.operators.network import min_max_norm  # noqa: F401  (part of this family's interface)


def _strings(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def squish_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: squish(F.col(c)) for c in _strings(df)})


def strip_trailing_seps(df: DataFrame) -> DataFrame:
    return df.withColumns({c: strip_trailing_sep(F.col(c)) for c in _strings(df)})


def normalize_missing_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: normalize_missing(F.col(c)) for c in _strings(df)})


def clean_strings(df: DataFrame) -> DataFrame:
    """The three string steps in the order in which exports need them."""
    return normalize_missing_strings(strip_trailing_seps(squish_strings(df)))


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=subset)


def add_tc_per_year(df: DataFrame, as_of_year: int, digits: int | None = None, py_max: int | None = None) -> DataFrame:
    return df.withColumn("TC_year", tc_per_year("TC", "PY", as_of_year, digits, py_max))


def clean_authors(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    return df.withColumn("AU", clean_author("AU") if aliases is None else clean_author("AU", aliases))


def split_fields(df: DataFrame) -> DataFrame:
    """Multi-valued fields to arrays, for the columns that are there."""
    have = set(df.columns)
    if "AU" in have:
        df = df.withColumn("AU", split_field("AU", ", "))
        df = df.withColumn("AU_NR", F.size("AU").cast("long")).withColumn("AU1", first_author_label("AU"))
    if "AU_ID" in have:
        df = df.withColumn("AU_ID", split_field("AU_ID", ";"))
    for keywords in ("DE", "ID"):
        if keywords in have:
            df = df.withColumn(keywords, split_field(keywords, "; ", lower=True))
    if "C1" in have:
        df = df.withColumn("C1", split_field("C1", "; "))
    if "CR" in have:
        df = df.withColumn("CR", split_field("CR", "; ")).withColumn("NR", F.size("CR").cast("long"))
    return df


def first_authors(authors: DataFrame, key: str = "EID", order: str = "pos") -> DataFrame:
    """``(key, AU1, N_AU)`` from long author rows; only the first two authors are ever gathered."""
    n = authors.groupBy(key).agg(F.count(F.lit(1)).alias("N_AU"))
    top = top_per_group(authors, [key], [F.col(order)], 2, name="_rk")
    lead = top.groupBy(key).agg(
        F.max(F.when(F.col("_rk") == 1, F.col("AU"))).alias("_a"),
        F.max(F.when(F.col("_rk") == 2, F.col("AU"))).alias("_b"),
    )
    label = (
        F.when(F.col("N_AU") == 1, F.col("_a"))
        .when(F.col("N_AU") == 2, F.concat("_a", F.lit(" & "), "_b"))
        .otherwise(F.concat("_a", F.lit(" et al.")))
    )
    return n.join(lead, key).select(key, label.alias("AU1"), "N_AU")


def select_columns(
    df: DataFrame,
    drop: Iterable[str] = (),
    drop_prefix: str | None = None,
    rename: Mapping[str, str] | None = None,
    first: Sequence[str] = (),
    strip_prefix: str | None = None,
) -> DataFrame:
    """Drop by name and prefix, rename, move columns to the front, strip a name prefix."""
    gone = set(drop)
    names = [c for c in df.columns if c not in gone and not (drop_prefix and c.startswith(drop_prefix))]
    names = [c for c in first if c in names] + [c for c in names if c not in first]
    new = {c: c.removeprefix(strip_prefix) for c in names} if strip_prefix else {c: c for c in names}
    new.update({k: v for k, v in (rename or {}).items() if k in new})
    return df.select(*[F.col(c).alias(new[c]) for c in names])


def min_citation_pruning(cites: DataFrame, pubs: DataFrame, min_tc: int = 2, min_nr: int = 2, pub: str = "EID", ref: str = "SID", key: str = "XX") -> DataFrame:
    """Rows of the corpus whose reference is cited twice; then publications that keep two. One pass."""
    rows = cites.join(pubs.select(F.col(key).alias(pub)), pub, "left_semi")
    tc = rows.groupBy(ref).agg(F.count(F.lit(1)).alias("CR_TC")).where(F.col("CR_TC") >= min_tc)
    rows = rows.join(tc, ref)
    nr = rows.groupBy(pub).agg(F.count(F.lit(1)).alias("NR")).where(F.col("NR") >= min_nr)
    return rows.join(nr, pub)


def reference_table(cites: DataFrame, key: str = "SID", tc: str = "TC", tie: str = "EID", width: int = 25) -> DataFrame:
    """One row per cited reference, the highest count first, with a short label."""
    best = top_per_group(cites, [key], [F.col(tc).desc_nulls_last(), F.col(tie)], 1)
    return best.withColumn("SR", short_reference("AU1", "PY", "SO", width)).drop(tie)


def cited_author_works(refs: DataFrame, authors: DataFrame, key: str = "SID") -> DataFrame:
    """Long table of works per cited author with whole and fractional counts."""
    n = authors.groupBy(key).agg(F.count(F.lit(1)).alias("N_AU"))
    return authors.join(refs, key).join(n, key).select(
        "AU", key, "PY", "N_AU", ratio(F.lit(1), "N_AU").alias("N_frac"), "TC", ratio("TC", "N_AU").alias("TC_frac")
    )


def cited_author_table(works: DataFrame) -> DataFrame:
    """Totals per cited author. ``nest(works, ["AU"], "AU_PUB")`` gives the works as arrays."""
    return works.groupBy("AU").agg(
        F.count(F.lit(1)).alias("AU_N"), F.sum("N_frac").alias("AU_N_frac"),
        F.sum("TC").alias("AU_TC"), F.sum("TC_frac").alias("AU_TC_frac"),
    )


def assemble_publications(
    pubs: DataFrame,
    authors: DataFrame,
    references: DataFrame,
    children: Mapping[str, DataFrame] | None = None,
    key: str = "XX",
    child_key: str = "EID",
) -> DataFrame:
    """Publications that cite something, with author label, counts, short label and nested references.

    Further child tables (affiliations, subjects, funding) are nested and left-joined; a publication is one row.
    """
    au = first_authors(authors, child_key).withColumnRenamed(child_key, key)
    nr = references.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias("NR"))
    parts = nest(references, [child_key], "CR")
    for name, child in (children or {}).items():
        parts = parts.join(nest(child, [child_key], name), child_key, "left")
    out = pubs.join(au, key, "left").join(nr, key).join(parts.withColumnRenamed(child_key, key), key)
    return out.withColumn("SR", short_reference("AU1", "PY", "SO", 50, comma=True))


def author_countries(affiliations: DataFrame, lexicon: DataFrame, key: str = "EID", text: str = "C1") -> DataFrame:
    """``(key, AU_CO)``: distinct countries named in affiliation texts, sorted, joined by ``;``.

    Word groups of the text are matched to the ``lexicon(country)`` by an equality join, so the
    cost does not grow with the number of countries. Both sides are split into words alike, and groups are as long as
    the longest name.
    """
    def split(column):
        return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}_]+"), lambda w: w != "")

    words = split(text)
    names = lexicon.select(split("country").alias("_w"), F.col("country").alias("CN")).where(F.size("_w") > 0)
    max_words = names.agg(F.coalesce(F.max(F.size("_w")), F.lit(1))).scalar()
    grams = F.flatten(F.transform(
        F.sequence(F.lit(1), F.col("_most")),
        lambda n: F.when(
            F.size("_w") >= n,
            F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice(F.col("_w"), i, n), " ")),
        ).otherwise(F.array().cast("array<string>")),
    ))
    found = (
        affiliations.select(key, words.alias("_w"), max_words.alias("_most")).select(key, F.explode(F.array_distinct(grams)).alias("_g"))
        .join(names.select(F.array_join("_w", " ").alias("_g"), "CN"), "_g")
        .select(key, "CN").distinct()
    )
    # at most one row per country and key: bounded by the lexicon
    return found.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("CN")), ";").alias("AU_CO"))


def subset_by_name(record, names: Sequence[str]):
    """Keep the named elements of a map column."""
    return F.map_filter(record, lambda k, _: k.isin(list(names)))
