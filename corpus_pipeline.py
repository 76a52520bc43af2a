"""A corpus pipeline of the operators in ``citespark.llm``: rules, near duplicates, benchmark, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of
the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import table
from citespark.llm.decontamination import contaminated
from citespark.llm.jaccard import jaccard_classes
from citespark.llm.packing import pieces
from citespark.llm.pii import pseudonyms
from citespark.llm.quality import clean_documents
from citespark.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = "a key of the owner"


def shaped(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it now is."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    return shaped(clean_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id; of its repeated rows, one."""
    classes = jaccard_classes(docs).where("class_id <=> doc_id").groupBy("doc_id").count()
    kept = shaped(docs).join(classes, docs["doc_id"].eqNullSafe(classes["doc_id"])).drop(classes["doc_id"])
    once = kept.where("count = 1").drop("count")
    # A few ids stand in several rows: copies of one text become one row, other texts of the id stay as they are.
    return once.union(kept.where("count > 1").drop("count").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct()
    rows = shaped(docs).withColumn("hash", F.xxhash64("text"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["hash"] == found["text_hash"]),
                     "left_anti").drop("hash")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of personal numbers, dates and addresses."""
    return shaped(pseudonyms(docs, KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents that are left."""
    return pieces(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Tokenisation, near duplicates and pseudonyms have no SQL form; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name == STAGES[-1][0] else cut_lineage(made)
    return docs
