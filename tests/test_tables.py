"""Corpus, indicators, series, diversity, text and sources on hand fixtures."""

import os
import time

import pytest
from pyspark.sql import functions as F

from citespark.operators import cleaning as cl
from citespark.operators import corpus as co
from citespark.operators import diversity as dv
from citespark.operators import indicators as ind
from citespark.operators import series as se
from citespark.operators import text as tx
from citespark.operators import topics as tp
from citespark.session import fresh_path
from citespark.sources import exports as ex
from citespark.sources import records as rec


def test_batches(spark):
    df = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), ("z", 2)], "XX string, batch long")
    rep = co.ingest_report(df).orderBy("batch").collect()
    assert [tuple(r) for r in rep] == [(1, 2, 2, 2), (2, 2, 1, 3)]
    assert {r["XX"]: r["batch"] for r in co.first_wins_dedupe(df.repartition(3)).collect()} == {"x": 1, "y": 1, "z": 2}


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("k", i) for i in (70000, 1, 200000)], "XX string, pos long")
    assert {r["pos"]: r["XX"] for r in co.unique_keys(df).collect()} == {1: "k", 70000: "k_1", 200000: "k_2"}


def test_large_caps_are_exact(spark):
    df = spark.range(5000).select(F.col("id").alias("XX"), F.lit(1).alias("batch"))
    assert co.cap_per_batch(df, 2500).agg(F.max("XX")).first()[0] == 2499


def test_exclude_drops_nulls_too(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "DT string")
    assert [r[0] for r in co.exclude_values(df, [("DT", "a")]).collect()] == ["b"]


def test_country_names_of_several_words(spark):
    aff = spark.createDataFrame([("p", "Univ. X, Niger."), ("p", "Lab, United  States; y"), ("q", "Nigeria")], "EID string, C1 string")
    lex = spark.createDataFrame([("Niger",), ("Nigeria",), ("United States",)], "country string")
    assert {r["EID"]: r["AU_CO"] for r in cl.author_countries(aff, lex).collect()} == {"p": "Niger;United States", "q": "Nigeria"}


def test_pruning_is_one_pass(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "z")]
    got = cl.min_citation_pruning(spark.createDataFrame(rows, "EID long, SID string"), spark.createDataFrame([(1,), (2,), (3,)], "XX long"))
    assert {(r["EID"], r["SID"], r["CR_TC"], r["NR"]) for r in got.collect()} == {(1, "a", 3, 2), (1, "b", 2, 2), (2, "a", 3, 2), (2, "b", 2, 2)}


def test_gini(spark):
    df = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 0.0), ("b", 0.0), ("b", 3.0), ("z", 0.0)], "g string, x double")
    got = {r["g"]: r["gini"] for r in dv.gini(df, ["g"], "x").collect()}
    assert got["a"] == pytest.approx(0) and got["b"] == pytest.approx(2 / 3) and got["z"] is None


def test_zero_denominators(spark):
    one = spark.createDataFrame([(1, 1, 1, 1, 0.0, 0.0)], "com long, P long, n long, n_cum long, dgr_int double, dgr_int_cum double")
    assert ind.community_size_density(one.withColumn("dgr_int", F.lit(0.0))).first()["density_int"] is None
    assert {r["coh_int"] for r in dv.cohesion_internal(dv.grand_total_rows(one)).collect()} == {0.0}
    empty = spark.createDataFrame([], "com1 long, com2 long, P long, weight double")
    row = dv.diversity_external(empty, one).where("com = '1'").first()
    assert (row["D"], row["B"], row["V"], row["div_ext"], row["coh_ext"]) == (1.0, 0.0, 0.0, 0.0, 0.0)


def test_panel_fills_gaps_and_carries_sums(spark):
    nodes = spark.createDataFrame([(1, 2000, 5, 2, 4.0, 1.0), (2, 2001, 7, 1, 2.0, 2.0)], "com long, PY long, TC long, NR long, dgr double, dgr_int double")
    got = {(r["com"], r["PY"]): r for r in se.community_year_panel(nodes).collect()}
    assert len(got) == 4
    assert (got[(1, 2001)]["n"], got[(1, 2001)]["TC_cum"], got[(1, 2001)]["dgr_ratio"]) == (0, 5, 0.25)
    assert (got[(2, 2000)]["dgr_cum"], got[(2, 2000)]["dgr_ratio"]) == (0.0, 0.0)


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "t long, by string")
    got = se.series_with_share(df, "t", "by").groupBy("t").agg(F.sum("n_rel").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in got)


def test_null_labels_drop_before_the_share(spark):
    e = spark.createDataFrame([(1, 1, 1), (1, 1, None), (1, 1, 2)], "from long, com_bib long, com_cit long")
    p = spark.createDataFrame([(1, 2000)], "XX long, PY long")
    assert {r["com_cit"]: r["TC_rel"] for r in se.knowledge_base_over_time(e, p).collect()} == {1: 0.5, 2: 0.5}


def test_spectroscopy_fills_empty_years(spark):
    df = spark.createDataFrame([(2000,)] * 4 + [(2002,)] * 2, "PY long")
    got = {r["PY"]: (r["n"], r["deviation"]) for r in ind.reference_year_spectroscopy(df).collect()}
    assert got == {2000: (4, 2.0), 2001: (0, -2.0), 2002: (2, 0.0)}


def test_default_themes(spark):
    df = spark.createDataFrame([("Power in the CITY and business of the firm",), ("everyday life",)], "t string")
    rows = se.keyword_flags(df, "t").collect()
    assert [k for k, v in rows[0].asDict().items() if v] == ["Politics", "Geography", "Business"]
    assert [k for k, v in rows[1].asDict().items() if v] == ["Practices"]


def test_summary_levels(spark):
    with pytest.raises(ValueError):
        ind.gen_summary({}, "ALL")
    refs = spark.createDataFrame([(1, "J", "A (1990) J", 5), (2, "J", "B (1991) J", 9)], "SID long, SO string, SR string, TC long")
    au = spark.createDataFrame([(1, "A"), (2, "B"), (2, "A")], "SID long, AU string")
    rows = ind.gen_summary({"refs": refs, "authors": au}, "REF", "count", 5).orderBy("rn").collect()
    assert [(r["AU"], r["SO"], r["SR_TC"]) for r in rows] == [("A", "J", 9), ("B", None, 5)]


# text --------------------------------------------------------------------------
def test_clean_text(spark):
    df = spark.createDataFrame([(1, "R&amp;D studies &copy; 2019"), (2, None), (3, "cut�away rest")], "d long, t string")
    got = {r["d"]: r["t"] for r in df.select("d", tx.clean_text("t").alias("t")).collect()}
    assert got == {1: "R-and-amp;D studies 2019", 2: None, 3: "cut"}


def test_tidy_text(spark):
    df = spark.createDataFrame([(1, "National nations; the study of Élan and élan"), (2, None)], "d long, t string")
    got = {r["term"]: r["n"] for r in tx.text_tidy(df, "d", "t").collect()}
    assert got == {"nation": 1, "nations": 1, "élan": 2}
    lemmas = spark.createDataFrame([("nations", "nation"), ("national", "wrong")], "token string, lemma string")
    got = {r["term"]: r["n"] for r in tx.text_tidy(df, "d", "t", dictionary=lemmas).collect()}
    assert got == {"nation": 2, "élan": 2}


def test_ngrams_cross_block_borders(spark):
    words = [f"w{i}" for i in range(9000)]
    df = spark.createDataFrame([(1, " ".join(words))], "d long, t string")
    grams = tx.ngrams(tx.tokenize(df, "d", "t", position=True)).select("term").collect()
    want = words + [f"{a}_{b}" for a, b in zip(words, words[1:])] + [f"{a}_{b}_{c}" for a, b, c in zip(words, words[1:], words[2:])]
    assert sorted(r["term"] for r in grams) == sorted(want)


def test_stem_completion(spark):
    t = spark.createDataFrame([(1, "cities"), (1, "city"), (2, "city")], "document long, term string")
    stems = spark.createDataFrame([("cities", "citi"), ("city", "citi")], "term string, stem string")
    assert {r["term"] for r in tx.stem_complete(t, stems).collect()} == {"city"}


def test_topic_distance_bounds(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.5), (2, "b", 0.5), (3, "c", 1.0)]
    got = {(r["topic_i"], r["topic_j"]): r["jsd"] for r in tp.topic_distance(spark.createDataFrame(rows, "topic long, term string, beta double")).collect()}
    assert got[(1, 2)] == pytest.approx(0) and got[(1, 3)] == pytest.approx(0.693147, abs=1e-6)


def test_planted_topics(spark):
    a, b = "wind solar grid power".split(), "city bus train road".split()
    rows = [(d, w, 5) for d in range(40) for w in (a if d < 20 else b)]
    counts = spark.createDataFrame(rows, "document long, term string, n long")
    seen = []
    for _ in range(2):
        vectors, vocab = tp.doc_term_vectors(counts)
        model = tp.lda_fit(vectors, 2, max_iter=40)
        gamma = tp.doc_topics(model, vectors).cache()
        beta = tp.topic_terms(model, vocab)
        for df, key, value in ((gamma, "document", "gamma"), (beta, "topic", "beta")):
            sums = df.groupBy(key).agg(F.sum(value).alias("s")).collect()
            assert all(r["s"] == pytest.approx(1, abs=1e-6) for r in sums)
        seen.append({(r["document"], r["topic"]): round(r["gamma"], 6) for r in gamma.collect()})
    assert seen[0] == seen[1]
    top = {d: max((1, 2), key=lambda t: seen[0][(d, t)]) for d in range(40)}
    assert all(seen[0][(d, top[d])] > 0.8 for d in top)
    assert len({top[d] for d in range(20)}) == 1 and top[0] != top[39]


# sources ------------------------------------------------------------------------
def test_affiliation_shapes(spark):
    path = fresh_path(spark, "aff")
    lines = [
        '{"coredata":{"eid":"1"},"affiliation":{"affilname":"A","@id":"9"}}',
        '{"coredata":{"eid":"2"},"affiliation":[{"affilname":"B"},{"affilname":"C"}]}',
        '{"coredata":{"eid":"3"}}',
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = rec.affiliation_rows(rec.read_records(spark, path)).collect()
    assert sorted((r["EID"], r["C1"]) for r in got) == [("1", "A"), ("2", "B"), ("2", "C")]


def test_read_scopus_cleans_and_needs_fields(spark):
    path = fresh_path(spark, "scopus")
    df = spark.createDataFrame([("1", "A B., C D.;", "[No abstract available]", "5", "2000"), (None, "x", "y", "1", "2000"), ("1", "later", "y", "x", "2000")],
                               "EID string, AU string, AB string, TC string, PY string")
    ex.write_export(df, path)
    got = ex.read_scopus(spark, path, fields=["EID", "AU", "AB", "TC", "PY"]).collect()
    assert [(r["EID"], r["AU"], r["AU1"], r["AB"], r["TC"]) for r in got] == [("1", ["A B.", "C D."], "A B. & C D.", None, 5)]
    with pytest.raises(ValueError):
        ex.read_scopus(spark, path)


@pytest.mark.parametrize("multiline", [True, False])
def test_read_scopus_takes_rows_by_file_name_and_place(spark, multiline):
    path = fresh_path(spark, "scopus_order")
    head = ["EID", "Title", "Cited by", "Year"]
    first = [("a", "first a", 1, 2000), ("b", "first b", 1, 2000), ("a", "again a", 1, 2000)]
    second = [("b", "second b", 1, 2000), ("c", "c", 1, 2000)] + [(f"x{k:05d}", "filler " * 9, 1, 2000) for k in range(3000)]
    third = [("c", "third c", 1, 2000), ("d", "d", 1, 2000)]
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name, rows in (("scopus_1.csv", first), ("scopus_2.csv", second), ("scopus_3.csv", third), ("other_1.csv", [("z", "z", 1, 2000)])):
        lines = [",".join(head)] + [",".join(map(str, r)) for r in rows]
        target = hadoop.Path(f"{path}/{name}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(("\n".join(lines) + "\n").encode()))
        out.close()
    whole = [("a", "first a"), ("b", "first b"), ("c", "c")] + [r[:1] + (r[1].strip(),) for r in second[2:]] + [("d", "d")]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for limit in ("128m", "20k"):  # the larger second file is packed first; then it is cut where it can be
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
            read = lambda n=None: ex.read_scopus(
                spark, path, fields=["EID", "TI", "TC", "PY"], n_max=n, glob="scopus_*.csv", multiline=multiline)
            for n in (1, 2, 3, 1500):  # within the first file, at its border and beyond
                assert sorted((r["EID"], r["TI"]) for r in read(n).collect()) == sorted(whole[:n])
            assert sorted((r["EID"], r["TI"]) for r in read().collect()) == sorted(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_abstract_store_keeps_keys_unique(spark):
    path = fresh_path(spark, "store")
    df = spark.createDataFrame([("1", 2000, "t", ["a", "b"], ["c"], "x"), ("2", 2000, "t", [], [], None)],
                               "EID string, PY long, TI string, DE array<string>, ID array<string>, AB string")
    for _ in range(2):
        ex.append_abstracts(df, path)
    assert [(r["EID"], r["DE"]) for r in ex.scan_abstracts(spark, path).collect()] == [("1", "a; b")]


def test_streamed_ingestion_equals_the_batch(spark):
    from citespark.streaming.incremental import ingest_files

    src, store, chk = (fresh_path(spark, n) for n in ("in", "out", "chk"))
    schema = "XX long, batch long"
    parts = [[(1, 1), (2, 1)], [(2, 2), (3, 2)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest_files(spark, src, schema, store, chk).awaitTermination(60)
        time.sleep(0.1)
    got = {tuple(r) for r in spark.read.parquet(store).collect()}
    want = {tuple(r) for r in co.first_wins_dedupe(spark.createDataFrame(sum(parts, []), schema)).collect()}
    assert got == want


def test_community_and_topic_study(spark):
    from citespark.adapter import Corpus
    from citespark.plans.study import Settings, community_study, topic_study

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no driver tables")
    c = Corpus(spark, sf)
    s = Settings(edge_bib=4, com_size_bib=3, com2_size_bib=2, edge_cit=8, node_cit=10, com_size_cit=3, topics=2, sparse=0.9)
    out = community_study(c.pubs_dense, c.cites_dense, fresh_path(spark, "study"), s)
    assert out["M_bib"].count() > 0 and out["el_2m"].where("com_bib is null or com_cit is null").count() == 0
    topics = topic_study(c.abstracts.where("LA = 'en'"), fresh_path(spark, "topics"), s, document="EID")
    share = topics["topic_proportions"].agg(F.sum("share")).first()[0]
    assert share == pytest.approx(1)


def _small_tables(spark, root, orders=40, lines=3):
    """Orders with a few lines each, for the builders of export files."""
    n = spark.range(orders * lines)
    tables = {
        "nation": spark.range(3).selectExpr("cast(id as int) as n_nationkey", "concat('Land ', id) as n_name"),
        "supplier": spark.range(7).selectExpr("id as s_suppkey", "concat('Supplier ', id) as s_name", "cast(id % 3 as int) as s_nationkey"),
        "part": spark.range(11).selectExpr("id as p_partkey", "concat('part ', id) as p_name", "concat('TYPE', id % 4) as p_type", "concat('Brand#', id % 2) as p_brand"),
        "customer": spark.range(5).selectExpr("id as c_custkey", "concat('Journal ', id % 2) as c_mktsegment"),
        "orders": spark.range(orders).selectExpr("id as o_orderkey", "id % 5 as o_custkey", "'1-URGENT' as o_orderpriority",
                                                 "cast(1000 as double) as o_totalprice", "timestamp '1996-02-03 00:00:00' as o_orderdate"),
        "lineitem": n.selectExpr(f"id div {lines} as l_orderkey", "id % 11 as l_partkey", "id % 7 as l_suppkey", f"cast(id % {lines} + 1 as int) as l_linenumber"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_records_are_written_compressed_and_hold_every_line(spark, tmp_path):
    from citespark.adapter import Corpus
    from citespark.queries import sources

    records = sources._records(Corpus(spark, _small_tables(spark, tmp_path)))
    assert all(f.endswith(".gz") for f in records.inputFiles())
    got = {r["EID"]: r for r in records.selectExpr(
        "EID", "authors.author.`@auid` as a", "item.bibrecord.tail.bibliography.reference.`ref-info`.`ref-title`.`ref-titletext` as t",
        "affiliation as f").collect()}
    assert set(got) == {str(k) for k in range(40)}
    for k in range(40):
        lines = range(3 * k, 3 * k + 3)
        assert got[str(k)]["a"] == [str(i % 7) for i in lines] and got[str(k)]["t"] == [f"  part {i % 11}" for i in lines]
        assert all(f"Land {i % 7 % 3}" in got[str(k)]["f"] for i in lines)


def test_entries_are_dealt_over_files(spark, tmp_path, monkeypatch):
    from citespark import queries as registry
    from citespark.queries import sources

    registry.load()
    monkeypatch.setattr(sources, "ENTRIES_OF_A_FILE", 4, raising=False)
    got = registry.QUERIES["records_xml"](spark, _small_tables(spark, tmp_path))
    assert len(got.inputFiles()) >= 10
    rows = {r["scopusID"]: r for r in got.collect()}
    assert set(rows) == {str(k) for k in range(40)} and rows["1"]["authors"] == "Supplier 3 X|Supplier 4 X|Supplier 5 X"


def test_texts_are_cut_into_words_once(spark, tmp_path, monkeypatch):
    from citespark.adapter import Corpus

    spark.range(20).selectExpr("id as doc_id", "concat('evolving markets and market ', id % 3 + 100) as text", "'en' as lang", "'web' as source",
                               "9L as n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = Corpus(spark, str(tmp_path))
    assert all("/stage-" in f for f in c.text_tidy.inputFiles())  # not the documents again in each step
    assert c.text_tidy.where("term = 'evolving' AND n = 1").count() == 20
    assert all("/stage-" in f for f in c.gamma.inputFiles())


def test_texts_are_cleaned_once_and_nulls_go_before(spark, capsys):
    df = spark.createDataFrame([(1, "Wind &amp; wind"), (2, None), (None, "sun power")], "EID long, AB string")
    counts = tx.text_tidy(df, "EID", "AB")
    capsys.readouterr()
    counts.explain()
    assert capsys.readouterr().out.count("�.*") == 1  # not again in a filter before
    assert {tuple(r) for r in counts.collect()} == {(1, "wind", 2), (1, "amp", 1)}


def test_counts_stay_in_place_when_sparse_terms_go(spark, capsys):
    rows = [(d, w, 1) for d in range(200) for w in ("often", f"once{d}")] + [(0, "twice", 1), (1, "twice", 1), (2, "thrice", 1)]
    counts = spark.createDataFrame(rows + [(3, "thrice", 2), (4, "thrice", 1), (5, None, 1)], "document long, term string, n long")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for Catalyst's own choice
    try:
        kept = tx.remove_sparse_terms(counts)
        got = sorted((r["document"], r["term"], r["n"]) for r in kept.where("term != 'often'").collect())
        capsys.readouterr()
        kept.explain()
        assert "SortMergeJoin" not in capsys.readouterr().out
        tx.remove_sparse_terms(counts, 0.9999).explain()  # a share without a small bound is left to Catalyst
        assert "SortMergeJoin" in capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == [(2, "thrice", 1), (3, "thrice", 2), (4, "thrice", 1)] and kept.count() == 203


def test_vectors_are_stored_without_python(spark, monkeypatch):
    from pyspark.ml.linalg import SparseVector

    counts = spark.createDataFrame([(7, "b", 2), (7, "a", 1), (7, "b", 3), (8, "c", 4), (None, "a", 6)], "document long, term string, n long")
    monkeypatch.setattr(tp.F, "udf", None)
    vectors, index = tp.doc_term_vectors(counts)
    assert {r["document"]: r["features"] for r in vectors.collect()} == {
        7: SparseVector(3, {0: 1.0, 1: 5.0}), 8: SparseVector(3, {2: 4.0}), None: SparseVector(3, {0: 6.0})}
    assert {tuple(r) for r in index.collect()} == {(0, "a"), (1, "b"), (2, "c")}


def test_ngram_counts_travel_in_blocks(spark, monkeypatch):
    """As many rows as a plain count, whatever is packed at once, and no n-gram is sorted or hashed as a row of a shuffle."""
    words = ["a", "bb", "c", "é", "語", "x1"]
    rows = [(d % 7, d // 7, words[d * d % 11 % 6] * (400 if d == 60 else 1)) for d in range(140)] + [(50, 0, "alone"), (None, 0, "a"), (None, 1, "bb")]
    grams = tx.ngrams(spark.createDataFrame(rows * 2, "document long, pos int, term string").repartition(5))
    want = sorted(map(tuple, grams.groupBy("size", "term").agg(F.count(F.lit(1)).alias("n")).collect()))
    for at_once in (tx.GRAMS_AT_ONCE, 20):
        monkeypatch.setattr(tx, "GRAMS_AT_ONCE", at_once)
        made = tx.ngram_counts(grams)
        assert made.columns == ["size", "term", "n"] and sorted(map(tuple, made.collect())) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange hashpartitioning(bucket" in plan
    assert sorted(map(tuple, tx.ngram_counts(grams.withColumn("term", F.replace("term", F.lit("_"), F.lit(" "))), " ").collect())) == sorted(
        (size, term.replace("_", " "), n) for size, term, n in want)
    assert tx.ngram_counts(grams.limit(0)).count() == 0
