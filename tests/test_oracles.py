"""Registered queries against their SQL in DuckDB; set CHECK_ALL=1 for every one of them."""

import math
import os

import pytest

from citespark import queries as registry

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("CHECK_SF", "/root/testdata/sf0.001")
registry.load()
SOME = [
    "bib_coupling", "weighted_degree", "series_with_share", "first_wins_dedupe", "cited_author_table", "modularity",
    "community_period_panel", "gini", "term_counts", "extract_affiliations", "ngrams", "ngrams_of_tokens", "term_saliency",
    "keyword_flags", "keyword_series", "resolve_references", "term_matrix", "doc_term_vectors", "topic_model_sums", "read_scopus", "author_countries",
    "expand_from_seeds", "seed_list", "top_cited_export", "export_ids_csv", "assemble_publications", "co_citation",
]
NAMES = sorted(registry.ORACLES) if os.environ.get("CHECK_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    if not os.path.exists(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _key(row):
    return tuple(("~" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    want = sorted(_key([row[i] for i in place]) for row in cur.fetchall())
    assert sorted(_key(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()) == want


def test_all_operators_are_registered():
    assert len(registry.QUERIES) >= 159
    assert set(registry.ORACLES) <= set(registry.QUERIES)
