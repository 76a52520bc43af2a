"""First-wins ingestion of export files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from citespark.operators.corpus import first_wins_dedupe


def ingest_files(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, key: str = "XX", batch: str = "batch") -> StreamingQuery:
    """Append each key once to ``store``; later copies of a stored key are ignored.

    The keys live in the store itself, not in streaming state, so nothing grows in memory, and
    a repeated micro-batch finds its keys already stored.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def add(rows: DataFrame, _: int) -> None:
        fresh = first_wins_dedupe(rows, key, batch)
        try:
            known = rows.sparkSession.read.parquet(store).select(key)
            fresh = fresh.join(known, key, "left_anti")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise  # only a store that is not there yet has nothing stored
        fresh.write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
