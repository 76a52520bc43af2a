"""Topic model and the tables derived from its topic-term and document-topic weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from citespark.functions import ratio, top_per_group
from citespark.operators.gibbs import term_index, term_matrix
from citespark.session import cut_lineage


def doc_term_vectors(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sparse count vectors, one per document, from ``(document, term, n)``, and the table ``(index, term)`` of their places.

    The terms are numbered as a distributed table; only their number comes to the driver. A document is one row of its
    distinct terms, written as the struct that a vector is stored as and read back as a vector.
    """
    counts = cut_lineage(counts)
    index = cut_lineage(term_index(counts))
    size = max(index.count(), 1)
    rows = term_matrix(counts, index).groupBy("document").agg(F.array_sort(F.collect_list(F.struct("index", "n"))).alias("row"))
    stored = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("row.index").cast("array<int>").alias("indices"),
        F.col("row.n").cast("array<double>").alias("values"))  # type 0 is sparse
    rows = rows.select("document", stored.alias("features"))
    schema = StructType([rows.schema["document"], StructField("features", VectorUDT())])
    return cut_lineage(rows, schema), index


def lda_fit(vectors: DataFrame, k: int = 6, seed: int = 1337, max_iter: int = 30, optimizer: str = "online") -> LDAModel:
    """Variational LDA. Each document's gamma is drawn from its place, so the rows are ordered first."""
    staged = cut_lineage(vectors.orderBy("document")).persist()  # every iteration reads it
    try:
        return LDA(k=k, seed=seed, maxIter=max_iter, optimizer=optimizer, featuresCol="features",
                   topicDistributionCol="gamma").fit(staged)
    finally:
        staged.unpersist()


def topic_terms(model: LDAModel, index: DataFrame) -> DataFrame:
    """Long beta: (topic, term, beta), every topic summing to one."""
    long = model.describeTopics(maxTermsPerTopic=model.vocabSize()).select(
        (F.col("topic") + 1).cast("long").alias("topic"), F.explode(F.arrays_zip("termIndices", "termWeights")).alias("_t"))
    long = long.select("topic", F.col("_t.termIndices").cast("long").alias("index"), F.col("_t.termWeights").alias("beta"))
    return long.join(index, "index").select("topic", "term", "beta")


def doc_topics(model: LDAModel, vectors: DataFrame) -> DataFrame:
    """Long gamma: (document, topic, gamma)."""
    mixed = model.transform(vectors).select("document", vector_to_array("gamma").alias("_g"))
    return mixed.select("document", F.posexplode("_g").alias("_i", "gamma")).select(
        "document", (F.col("_i") + 1).cast("long").alias("topic"), "gamma")


# given beta -----------------------------------------------------------------------
def topic_top_terms(beta: DataFrame, n: int = 10, ties: bool = True) -> DataFrame:
    order = [F.desc("beta")] if ties else [F.desc("beta"), F.col("term")]
    return top_per_group(beta, ["topic"], order, n, ties=ties, name="rank")


def term_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("n").alias("freq"))


def term_saliency(beta: DataFrame, shares: DataFrame, counts: DataFrame) -> DataFrame:
    """``freq(w) * sum_t p(t|w) log(p(t|w) / p(t))`` with ``shares(topic, share)`` as p(t)."""
    # with j = beta p(t) and s = sum_t j: sum_t (j / s) log(j / s / p(t)) = sum_t j log(beta) / s - log(s), one aggregate
    joint = beta.join(shares.select("topic", F.col("share").alias("_pt")), "topic").withColumn("_j", F.col("beta") * F.col("_pt"))
    logs = F.when(F.col("_j") > 0, F.col("_j") * F.ln("beta")).otherwise(0.0)
    sums = joint.groupBy("term").agg(F.sum("_j").alias("_s"), F.sum(logs).alias("_l"))
    distinct = sums.select("term", F.when(F.col("_s") > 0, F.col("_l") / F.col("_s") - F.ln("_s")).otherwise(0.0).alias("_d"))
    return distinct.join(term_frequencies(counts), "term").select("term", "freq", (F.col("freq") * F.col("_d")).alias("saliency"))


def term_relevance(beta: DataFrame, counts: DataFrame, lam: float = 0.6, top: int = 30) -> DataFrame:
    """``lam log p(w|t) + (1 - lam) log(p(w|t) / p(w))``, the best terms of each topic."""
    tf = term_frequencies(counts)
    total = tf.agg(F.sum("freq")).scalar()
    pw = tf.select("term", ratio("freq", total).alias("_pw"))
    rows = beta.where(F.col("beta") > 0).join(pw, "term")
    logp = F.ln("beta")
    scored = rows.withColumn("relevance", F.lit(lam) * logp + F.lit(1 - lam) * (logp - F.ln("_pw")))
    return top_per_group(scored, ["topic"], [F.round("relevance", 9).desc(), F.col("term")], top, name="rank").drop("_pw")


def topic_distance(beta: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence of each topic pair.

    With m = (p + q) / 2 the divergence is ln 2 plus sums over terms that both topics hold:
    a term of one topic only adds ``p/2 ln 2``. So only shared terms are paired.
    """
    pair = beta.withColumnsRenamed({"topic": "topic_i", "beta": "p"}).join(
        beta.withColumnsRenamed({"topic": "topic_j", "beta": "q"}), "term").where(F.col("topic_i") < F.col("topic_j"))
    p, q = F.col("p"), F.col("q")

    def half(x):
        return F.when(x > 0, x * (F.ln(x * 2 / (p + q)) - F.ln(F.lit(2.0)))).otherwise(0.0)

    shared = pair.groupBy("topic_i", "topic_j").agg(F.sum(half(p) + half(q)).alias("_s"))
    topics = beta.select("topic").distinct()
    pairs = topics.select(F.col("topic").alias("topic_i"), F.explode(
        topics.agg(F.sort_array(F.collect_set("topic"))).scalar()).alias("topic_j")).where(F.col("topic_i") < F.col("topic_j"))
    out = pairs.join(shared, ["topic_i", "topic_j"], "left")
    return out.select("topic_i", "topic_j", (F.ln(F.lit(2.0)) + F.coalesce("_s", F.lit(0.0)) / 2).alias("jsd"))


# given gamma ----------------------------------------------------------------------
def dominant_topic(gamma: DataFrame, pubs: DataFrame, key: str = "EID") -> DataFrame:
    """Topic with the largest weight (lowest number on ties), joined to all publications."""
    best = gamma.groupBy("document").agg(F.max_by("topic", F.struct("gamma", -F.col("topic"))).alias("topic"))
    return pubs.join(best.withColumnRenamed("document", key), key, "left")


def topic_edges(gamma: DataFrame, pubs: DataFrame, labels: DataFrame, key: str = "EID") -> DataFrame:
    rows = gamma.withColumnsRenamed({"document": key, "gamma": "weight"}).join(pubs.select(key, "PY"), key)
    return rows.join(labels.select(F.col("id").alias(key), "com"), key, "left")


def topic_proportions(gamma: DataFrame, counts: DataFrame, topics: Sequence[int] | None = None) -> DataFrame:
    """Tokens and share of each topic: ``sum_d gamma(d,t) len(d)``."""
    length = counts.groupBy("document").agg(F.sum("n").alias("len"))
    if topics is not None:
        gamma = gamma.where(F.col("topic").isin(list(topics)))
    per = gamma.join(length, "document").groupBy("topic").agg(F.sum(F.col("gamma") * F.col("len")).alias("tokens"))
    total = per.agg(F.sum("tokens")).scalar()
    return per.select("topic", "tokens", ratio("tokens", total).alias("share"))
