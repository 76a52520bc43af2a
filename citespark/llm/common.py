"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS_OF_A_FILE = 50_000


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its DuckDB form if SQL can express it."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """The word vocabulary of the contract; installed on every machine like any other library."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Arrow batches of at most ``rows`` rows for the Python stages of this session, so that a task holds few texts."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, rows + 1):
        spark.conf.set(key, str(rows))
    return df


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most about ``rows`` rows in as few tasks as these fill, 8 at least: a stage table is else cut into as
    many small files as there are shuffle partitions, whatever its size. Each file costs its writer two commands on a
    local disk."""
    return df.coalesce(max(8, -(-rows // ROWS_OF_A_FILE)))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns of any name never reach the operators."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
