"""Shape of the physical plans."""

import os

import pytest

from citespark import queries as registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no driver tables")
registry.load()


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "bib_coupling", "node_percent_rank_cut", "community_year_panel", "two_mode_year", "main_info", "quantile_or_filter",
    "min_max_norm", "term_relevance", "topic_distance", "author_countries",
])
def test_no_cross_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["first_wins_dedupe", "most_central", "expand_from_seeds", "pub_summary_top"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_terms_need_one_shuffle_and_two_columns(spark):
    text = plan(spark, "term_counts")
    assert text.count("Exchange") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_filters_reach_the_scan(spark):
    text = plan(spark, "exclude_values")
    assert "PushedFilters: [" in text and "Not(EqualTo(o_orderpriority,5-LOW))" in text


def test_degrees_are_aggregated_before_the_shuffle(spark):
    assert "partial_sum" in plan(spark, "weighted_degree")
