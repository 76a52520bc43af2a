"""The study from corpus to communities, and from abstracts to topics, as stage tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from citespark.operators import community, network, series, text, topics
from citespark.operators.corpus import restrict_to_network


@dataclass(frozen=True)
class Settings:
    """Cut-offs of the study; all of them depend on the size of the corpus."""

    seed: int = 1337
    edge_bib: int = 4            # coupling edges kept from this weight on
    node_pct_bib: float = 0.10   # share of the least connected publications dropped
    com_size_bib: int = 500
    com2_size_bib: int = 100
    edge_cit: int = 3
    node_cit: int = 50           # co-citation nodes kept from this degree on
    com_size_cit: int = 200
    topics: int = 6
    sparse: float = 0.99


def _stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def community_study(pubs: DataFrame, cites: DataFrame, folder: str, s: Settings = Settings()) -> dict[str, DataFrame]:
    """Research areas, knowledge bases and the links between them; every result is a stage table.

    ``pubs(XX, …)``, ``cites(EID, SID)``. Tables: ``M_bib``, ``g_bib_agg_nodes/edges``, ``C_nw``,
    ``g_cit_agg_nodes/edges``, ``el_2m``.
    """
    rows = _stage(network.incidence(cites), folder, "incidence")

    # research areas
    edges = _stage(network.bib_coupling(rows, min_weight=s.edge_bib), folder, "el_bib")
    nodes = network.weighted_degree(edges)
    nodes, edges = network.node_percent_rank_cut(nodes, edges, s.node_pct_bib)
    edges = _stage(edges, folder, "el_bib_cut")
    labels = community.louvain_two_level(nodes.select("id"), edges, s.seed)
    graded = _stage(network.internal_degree(labels, edges), folder, "bib_degrees")
    kept, inner = network.community_size_filter(graded, edges, s.com_size_bib, s.com2_size_bib)
    m_bib = _stage(kept, folder, "M_bib")
    agg_nodes, agg_edges = network.community_network(m_bib, inner)

    # knowledge bases, on the publications that stayed
    small = restrict_to_network(rows.withColumnRenamed("EID", "XX"), m_bib).withColumnRenamed("XX", "EID")
    co = _stage(network.co_citation(small, min_weight=s.edge_cit), folder, "el_cit")
    refs = network.weighted_degree(co)
    refs, co = network.node_degree_cut(refs, co, k=s.node_cit)
    co = network.degree_jaccard(co, refs)
    co = _stage(co, folder, "el_cit_cut")
    bases = community.louvain(refs.select("id"), co, s.seed)
    graded = network.internal_degree(bases, co)
    kept, inner = network.community_size_filter(graded, co, s.com_size_cit)
    kept = network.weighted_degree(inner, kept, "weight_jac", "dgr_jac")
    c_nw = _stage(kept, folder, "C_nw")
    cit_nodes, cit_edges = network.community_network(c_nw, inner)

    return {
        "M_bib": m_bib,
        "g_bib_agg_nodes": _stage(agg_nodes, folder, "g_bib_agg_nodes"),
        "g_bib_agg_edges": _stage(agg_edges, folder, "g_bib_agg_edges"),
        "C_nw": c_nw,
        "g_cit_agg_nodes": _stage(cit_nodes, folder, "g_cit_agg_nodes"),
        "g_cit_agg_edges": _stage(cit_edges, folder, "g_cit_agg_edges"),
        "el_2m": _stage(network.two_mode_edges(small, m_bib, c_nw), folder, "el_2m"),
        "pubs": pubs.join(m_bib.withColumnRenamed("id", "XX"), "XX"),
    }


def topic_study(
    docs: DataFrame, folder: str, s: Settings = Settings(), document: str = "XX", abstract: str = "AB",
    stop_words: DataFrame | Sequence[str] = text.STOP_WORDS, dictionary: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Terms, topics and topic shares of abstracts with a year ``PY``."""
    tidy = _stage(text.text_tidy(docs, document, abstract, stop_words, dictionary), folder, "text_tidy")
    dtm = _stage(text.remove_sparse_terms(tidy, s.sparse), folder, "dtm")
    vectors, vocabulary = topics.doc_term_vectors(dtm)
    model = topics.lda_fit(vectors, s.topics, s.seed)
    beta = _stage(topics.topic_terms(model, vocabulary), folder, "beta")
    gamma = _stage(topics.doc_topics(model, vectors), folder, "gamma")
    shares = topics.topic_proportions(gamma, dtm)
    return {
        "text_tidy": tidy, "beta": beta, "gamma": gamma, "topic_proportions": shares,
        "top_terms": topics.topic_top_terms(beta), "saliency": topics.term_saliency(beta, shares, dtm),
        "relevance": topics.term_relevance(beta, dtm), "distance": topics.topic_distance(beta),
        "topics_over_time": series.topics_over_time(gamma, docs, key=document),
    }
