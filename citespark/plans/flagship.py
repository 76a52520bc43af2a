"""Output per year and source, with the coupling strength behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.adapter import Corpus
from citespark.functions import ratio
from citespark.operators.network import bib_coupling, weighted_degree
from citespark.operators.series import with_share


def coupled_output(spark: SparkSession, sf_dir: str, min_weight: int = 2) -> DataFrame:
    """Publications per year and source, share in the year, and mean coupling strength."""
    c = Corpus(spark, sf_dir)
    strength = weighted_degree(bib_coupling(c.cites_dense, min_weight=min_weight)).withColumnRenamed("id", "XX")
    rows = c.pubs_dense.join(strength, "XX", "left")
    per = rows.groupBy("PY", "SO").agg(F.count(F.lit(1)).alias("n"), F.sum("dgr").alias("_d"))
    out = with_share(per, "PY", "n", "n_rel")
    return out.select("PY", "SO", "n", F.round("n_rel", 6).alias("n_rel"),
                      F.round(F.coalesce(ratio("_d", "n"), F.lit(0.0)), 6).alias("mean_strength"))
