"""Reference strings, term index and Gibbs sampling: hand fixtures, recall and planted topics."""

import pytest
from pyspark.sql import functions as F

from citespark.operators import gibbs as gb
from citespark.operators import linkage as ln

PUBS = [(1, "Nelson R.R.", 1982, "An Evolutionary Theory of Economic Change"), (2, "Dosi G.", 1982, "Technological paradigms and trajectories"),
        (3, "Smith A.", 1999, "Editorial"), (4, "Smith B.", 1999, "Editorial"), (5, "Müller K.", 2001, "Über Innovation und Wandel"),
        (6, None, 2001, "No author"), (7, "X", None, "No year"), (8, "Y", 2001, None)]
STRINGS = {"Nelson R.R., Winter S., An evolutionary theory of economic change, (1982) Belknap": (1, "matched"),
           "NELSN R.R., AN EVOLUTIONARY THEORY OF ECONOMIC CHANGE (1982)": (1, "matched"),
           "Nelson R.R., An evolutionary theory of economic change (1983)": (1, "matched"),
           "Nelsn R.R., An evolutionary theory of economic change (1983)": (None, "unmatched"),  # both wrong
           "Nelson R.R., An evolutionary theory of change, (1982) Belknap": (1, "matched"),
           "Nelson R.R., An evolutionary theory of economic change": (None, "unmatched"),
           "Smith C., Editorial, (1999) Research Policy": (None, "ambiguous"),
           "Mueller K., Innovation und Wandel, (2001)": (None, "unmatched"), "Müler K., Über Innovation und Wandel (2001)": (5, "matched"),
           "": (None, "unmatched"), "(1982)": (None, "unmatched"), "Dosi G., Something else entirely, (1982) J": (None, "unmatched")}


def test_strings_are_linked_or_kept_apart(spark):
    pubs = spark.createDataFrame(PUBS, "XX long, AU1 string, PY int, TI string")
    cites = spark.createDataFrame([(e, s) for e in (90, 91) for s in [*STRINGS, None]], "EID long, CR string")
    found = ln.resolve_references(pubs, cites)
    assert {r["ref"]: (r["id"], r["status"]) for r in found.collect()} == STRINGS
    linked = ln.resolved_citations(cites, found)
    assert sorted(map(tuple, linked.collect())) == [(90, 1), (90, 5), (91, 1), (91, 5)]  # each once
    assert ln.resolve_references(pubs, cites.limit(0)).count() == 0
    assert {r["status"] for r in ln.resolve_references(pubs.limit(0), cites).collect()} == {"unmatched"}


def test_recall_of_planted_errors(spark):
    """Of strings with one error nine in ten and more are found, and none is linked to another work."""
    from citespark.adapter import Corpus
    from citespark.queries.linkage import reference_strings

    works, strings = reference_strings(Corpus(spark, "/root/testdata/sf0.001"))
    found = strings.join(ln.resolve_references(works, strings), F.col("CR") == F.col("ref")).withColumn("kind", (F.col("EID") + 7 * F.col("SID")) % 10)
    twins = F.col("SID") % 100 < 2
    got = {r["kind"]: r for r in found.where(~twins).groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(F.col("id") == F.col("SID")).alias("right"), F.count("id").alias("linked")).collect()}
    assert all(r["right"] == r["linked"] for r in got.values())
    assert all(got[k]["right"] >= 0.9 * got[k]["n"] for k in got if k != 3) and got[3]["linked"] == 0  # no year
    assert {r["status"] for r in found.where(twins & (F.col("kind") > 4)).collect()} == {"ambiguous"}


def test_many_copies_of_a_title_are_one_candidate(spark):
    pubs = spark.range(3000).select(F.col("id").alias("XX"), F.lit("Smith A.").alias("AU1"), F.lit(1999).alias("PY"), F.lit("Editorial").alias("TI"))
    cites = spark.range(3000).select(F.col("id").alias("EID"), F.lit("Smith A., Editorial, (1999) J").alias("CR"))
    assert [tuple(r) for r in ln.resolve_references(pubs, cites).collect()] == [("Smith A., Editorial, (1999) J", None, 1.0, "ambiguous")]


def test_term_index_is_the_order_of_terms(spark):
    terms = [f"t{k * 7919 % 1000:03d}" for k in range(1000)] + ["Ä", "z", "a b"]
    counts = spark.createDataFrame([(d, t, 2) for d in (1, 2) for t in terms] + [(3, None, 1)], "document long, term string, n long")
    index = gb.term_index(counts.repartition(7))
    assert {r["term"]: r["index"] for r in index.collect()} == {t: k for k, t in enumerate(sorted(terms, key=str.encode))}
    assert gb.term_matrix(counts, index).count() == 2 * len(terms) and gb.term_index(counts.limit(0)).count() == 0


def test_gibbs_recovers_topics_whatever_the_partitions(spark):
    rows = [(d, f"{'ab'[d % 2]}{(d * 7 + j * 5) % 12}", 1 + j % 3) for d in range(30) for j in range(8)]
    counts = spark.createDataFrame(rows, "document long, term string, n long")
    index = gb.term_index(counts).cache()
    seen = []
    for n in (1, 6):
        tokens = gb.gibbs_fit(gb.term_matrix(counts, index).repartition(n), 2, sweeps=10, alpha=0.5).cache()
        gamma = gb.gibbs_doc_topics(tokens, 2, 0.5).collect()
        beta = gb.gibbs_topic_terms(tokens, index, 2)
        assert sum(r["n"] for r in gamma) == sum(r[2] for r in rows)
        assert all(r["s"] == pytest.approx(1) for r in beta.groupBy("topic").agg(F.sum("beta").alias("s")).collect())
        seen.append({(r["document"], r["topic"]): r["n"] for r in gamma})
    assert seen[0] == seen[1]
    side = [max((1, 2), key=lambda t: seen[0][d, t]) for d in range(30)]
    assert len({side[d] for d in range(0, 30, 2)}) == len({side[d] for d in range(1, 30, 2)}) == 1 and side[0] != side[1]


def test_gibbs_sweeps_over_blocks_draw_as_joins_do(spark, monkeypatch):
    """Repeated rows, missing documents and a document cut into pieces; no sweep joins single tokens."""
    rows = [(f"d{d}" if d else None, (d * 7 + j * 5) % 40 - 3, (d + j) % 4) for d in range(25) for j in range(6)]
    rows += [rows[7], ("d3", 9, 2500), ("d4", 900, 1500)]
    matrix = spark.createDataFrame(rows, "document string, index int, n long").repartition(3)

    def fit(k, seed):
        return sorted(map(tuple, gb.gibbs_fit(matrix, k, sweeps=2, alpha=0.5, seed=seed).collect()))

    with monkeypatch.context() as m:
        m.setattr(gb, "SENT_COUNTS", 0)
        want = fit(3, 1337), fit(2, 1 << 40)
    monkeypatch.setattr(gb, "_swept", None)
    assert (fit(3, 1337), fit(2, 1 << 40)) == want
    monkeypatch.setattr(gb, "PIECE", 1)  # at least 1,024 tokens
    assert fit(3, 1337) == want[0]
    assert len(want[0]) == sum(r[2] for r in rows if r[0]) and {t for *_, t in want[0]} == {0, 1, 2}
