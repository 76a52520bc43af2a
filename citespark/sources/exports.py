"""Reading and writing of tabular exports, stage tables and the abstract store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from citespark.operators.cleaning import clean_strings, split_fields
from citespark.operators.corpus import cap_per_batch, exclude_values, first_wins_dedupe, range_filter, unique_keys
from citespark.functions import tc_per_year, top_per_group
from citespark.session import cut_lineage

# Field tags of an export and their column headers.
TAGS = {
    "EID": "EID", "AU": "Authors", "AU_ID": "Author(s) ID", "TI": "Title", "SO": "Source title",
    "JI": "Abbreviated Source Title", "DT": "Document Type", "DE": "Author Keywords", "ID": "Index Keywords",
    "AB": "Abstract", "C1": "Affiliations", "TC": "Cited by", "PY": "Year", "LA": "Language of Original Document",
    "DI": "DOI", "AR": "Art. No.", "BE": "Editors", "FU": "Funding.Details", "BN": "ISBN", "SN": "ISSN",
    "PN": "Page count", "PU": "Publisher", "VL": "Volume", "IS": "Issue", "FX": "Funding Text.1",
    "BP": "Page start", "EP": "Page end", "OS": "Access Type",
}
REDUCED = ("EID", "AU", "PY", "TI", "SO", "VL", "IS", "TC", "DE", "ID", "DT")
NUMERIC = {"TC": "long", "PY": "long"}


def _read_tags(
    spark: SparkSession, path: str | Sequence[str], tags: Sequence[str] | None, glob: str | None, multiline: bool = True,
) -> DataFrame:
    """Fields by tag, with ``_file`` and ``_place``: file, offset of its block, running id inside the block.

    ``_place`` orders rows by file name and then as they stand in the file, however Spark packs files
    and blocks into tasks. Without quoted line breaks (``multiline=False``) one file is read by many tasks.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", True).option("enforceSchema", False)  # files with other headers end the read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.csv(path)  # all fields are text; no inference pass over the data
    have = [t for t in (tags or TAGS) if TAGS[t] in raw.columns]
    cols = [F.col(f"`{TAGS[t]}`").try_cast(NUMERIC[t]).alias(t) if t in NUMERIC else F.col(f"`{TAGS[t]}`").alias(t) for t in have]
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))  # a block is read by one task, in order
    return raw.select(*cols, F.col("_metadata.file_path").alias("_file"), place.alias("_place"))


def batch_number(pattern: str = r"_(\d+)\.csv") -> F.Column:
    """Batch from the number in the file (or folder) name."""
    return F.regexp_extract("_file", pattern, 1).cast("long")


def read_collection(
    spark: SparkSession, path: str | Sequence[str], tc_min: int = 0, py_min: int | None = None, py_max: int | None = None,
    n_max: int | None = None, doc_types: Sequence[str] | None = None, glob: str | None = None, pos: str | None = None,
    batch_pattern: str = r"_(\d+)\.csv",
) -> DataFrame:
    """Many exports as one corpus: filter, cap each file, tag the batch, keep first occurrences.

    The cap comes before the filter on document types. Files have no order in Spark; ``pos``
    names an integer column that gives the place of a row in its file. Without it a file is taken
    in reading order, which needs each export to be a single file.
    """
    df = _read_tags(spark, path, None, glob).withColumn("batch", batch_number(batch_pattern)).drop("_file", "_place")
    df = df.withColumn("XX", F.col("EID"))
    if pos:
        df = df.withColumn("_pos", F.col(pos).try_cast("long"))
    else:
        # quoted line breaks keep a file in one task, so the running id follows the file's own order;
        # it is written down once, as later steps read it more than once
        df = cut_lineage(df.withColumn("_pos", F.monotonically_increasing_id()))
    df = range_filter(df, tc_min, py_min, py_max)
    if n_max is not None:
        df = cap_per_batch(df, n_max, "batch", "_pos")
    if doc_types is not None:
        df = df.where(F.col("DT").isin(list(doc_types)))
    return unique_keys(first_wins_dedupe(df, "EID", "batch", "_pos"), "XX", "_pos").drop("_pos")


def read_scopus(
    spark: SparkSession, path: str | Sequence[str], fields: Sequence[str] | None = None, type: str | None = None,
    tc_min: int = 0, tc_year_min: float = 0, py_min: int | None = None, py_max: int | None = None,
    n_max: int | None = None, exclude: Sequence[tuple[str, object]] = (), as_of_year: int = 2024, glob: str | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Export projected to field tags (``complete``, ``reduced`` or named), cleaned, split and filtered.

    Of several rows with one id the first counts and ``n_max`` takes the first rows, both by file name
    and then by place in the file. ``multiline=False`` splits large files among tasks; it is for exports
    without line breaks inside quotes.
    """
    if type is None and fields is None:
        raise ValueError("give a type or a list of fields")
    tags = {"complete": tuple(TAGS), "reduced": REDUCED}[type] if type else tuple(fields)
    # places are the same in every reading, so nothing is written down
    df = _read_tags(spark, path, tags, glob, multiline).drop("_file")
    df = clean_strings(df).dropna(subset=["EID"])
    if {"TC", "PY"} <= set(df.columns):
        df = df.withColumn("TC_year", tc_per_year("TC", "PY", as_of_year, 2))
    df = split_fields(df)
    df = top_per_group(df, ["EID"], [F.col("_place")], 1)
    if "PY" in df.columns:
        df = df.where(F.lit(True) if py_min is None else F.col("PY") >= py_min)
        df = df.where(F.lit(True) if py_max is None else F.col("PY") <= py_max)
    if "TC" in df.columns:
        df = df.where(F.col("TC") >= tc_min)
        if "TC_year" in df.columns:
            df = df.where(F.col("TC_year") >= tc_year_min)
    df = exclude_values(df, exclude)
    return (df.orderBy("_place").limit(n_max) if n_max is not None else df).drop("_place")


def seed_index(spark: SparkSession, path: str, column: str = "index") -> DataFrame:
    """Distinct, non-blank names of an index file."""
    df = spark.read.option("header", True).option("nullValue", "").csv(path).select(F.trim(column).alias(column))
    return df.where(F.col(column) != "").distinct()


def write_export(df: DataFrame, path: str) -> None:
    """Write a tagged table under its export headers."""
    df.select(*[F.col(c).alias(TAGS.get(c, c)) for c in df.columns]).write.option("header", True).option("escape", '"').csv(path)


# stage tables -------------------------------------------------------------------
def save_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# abstract store -------------------------------------------------------------------
def append_abstracts(df: DataFrame, path: str) -> None:
    """Create the store if missing and append new keys; rows without key or abstract stay out."""
    spark = df.sparkSession
    text = [F.concat_ws("; ", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    rows = df.select(*text).select("EID", "PY", "TI", "DE", "ID", "AB").dropna(subset=["EID", "AB"])
    rows = top_per_group(rows, ["EID"], [F.col(c) for c in ("PY", "TI", "AB")], 1)
    try:
        known = spark.read.parquet(path).select("EID")
        rows = rows.join(known, "EID", "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise  # only a store that is not there yet means a first write
    rows.write.mode("append").parquet(path)


def scan_abstracts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def incremental_fetch_plan(wanted: DataFrame, stored: DataFrame, key: str = "EID") -> DataFrame:
    """Wanted ids that are not stored yet."""
    return wanted.select(key).dropna().distinct().join(stored.select(key), key, "left_anti")


# exports of results ---------------------------------------------------------------
def export_ids(pubs: DataFrame, labels: DataFrame, key: str = "EID", text: str = "SR") -> DataFrame:
    """``(key, SR, com, com2)``: every publication once, with its labels."""
    lab = labels.withColumnRenamed("id", key).select(key, "com", "com2")
    out = pubs.select(key, text).join(lab, key, "left")
    return top_per_group(out, [key], [F.col(text), F.col("com"), F.col("com2")], 1)


def export_edgelist(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(i, j, weight, weight_count)`` with end points by name, from ``nodes(id, name)``."""
    out = edges
    for end, name in (("src", "i"), ("dst", "j")):
        out = out.join(nodes.select(F.col("id").alias(end), F.col("name").alias(name)), end)
    return out.select("i", "j", "weight", "weight_count")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def graph_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables for other tools: label defaults to the id, weight to 1."""
    label = F.col("label") if "label" in nodes.columns else F.lit(None)
    weight = F.col("weight") if "weight" in edges.columns else F.lit(None)
    return (
        nodes.withColumn("label", F.coalesce(label.cast("string"), F.col("id").cast("string"))),
        edges.withColumn("weight", F.coalesce(weight.cast("double"), F.lit(1.0))),
    )


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    n, e = graph_tables(nodes, edges)
    n.write.parquet(f"{path}/nodes")
    e.write.parquet(f"{path}/edges")
