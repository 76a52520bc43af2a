import corpus_pipeline as cp
from pyspark.sql import functions as F

from citespark.llm.decontamination import contaminated
from citespark.llm.jaccard import jaccard_classes
from citespark.llm.quality import quality_rules

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_its_own_input(spark, small, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = {r[0] for r in quality_rules(small).where("kept").select("doc_id").collect()}
    one = cp.quality_rules(spark, small, SF)
    assert one.columns == COLUMNS and {r[0] for r in one.collect()} == kept
    classes = jaccard_classes(small).select("doc_id", "class_id").collect()
    two = cp.near_duplicates(spark, small, SF)
    assert two.columns == COLUMNS and sorted(r["doc_id"] for r in two.collect()) == sorted({r["class_id"] for r in classes})
    bad = {r[0] for r in contaminated(small, bench).select("doc_id").collect()}
    three = cp.decontamination(spark, small, SF)
    assert bad and three.columns == COLUMNS
    assert {r[0] for r in three.collect()} == {r["doc_id"] for r in small.collect()} - bad
    four = cp.pii(spark, small, SF)
    assert four.columns == COLUMNS and four.count() == small.count()
    assert four.where(F.col("n_chars") != F.length("text")).count() == 0


def test_odd_rows_pass_every_stage(spark, odd, nothing):
    for docs in (odd, nothing):
        plain = docs.select(*COLUMNS)
        for name, stage in cp.STAGES:
            assert stage(spark, plain, SF).count() >= 0, name
    ids = [r["doc_id"] for r in cp.near_duplicates(spark, odd.select(*COLUMNS), SF).collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(7) == 2


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    rows = cp.run(spark, SF)
    assert {r[0] for r in rows.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "pii", "packing"]


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert "op8_benchmark_decontamination" in entry.oracle_sql() and "pipeline" not in entry.oracle_sql()
