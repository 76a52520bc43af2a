import hashlib
import re

from citespark.llm.secrets import candidates, op2, scan, sure_findings


def test_planted_tokens_are_found_and_words_are_not(spark):
    """The forest, trained on rules for three quarters of the documents, against the planted form in all of them."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r["doc_id"], hashlib.sha256(m.encode()).hexdigest()) for r in docs
                  for m in re.findall(r"(?i)token = \"([0-9a-f]{40})\"", r["text"]))
    rows = op2(spark, sf).collect()
    got = sorted((r["doc_id"], r["finding_sha256"]) for r in rows)
    assert len(set(want)) > 5 and set(want) <= set(got)
    assert len(set(got) - set(want)) <= 0.2 * len(set(got))
    assert all(0.5 <= r["probability"] <= 1 for r in rows)


def test_places_and_neighbours(spark):
    df = spark.createDataFrame([(1, "p", 'key = "abcdef0123456789ABCDEF" then wwwwwwwwwwwwwwwwwww.'), (2, None, None), (3, "q", "")],
                               "doc_id long, path string, text string")
    got = {(r["doc_id"], r["nth"]): (r["finding"], r["before"], r["after"]) for r in candidates(df).collect()}
    assert got == {(1, 0): ("abcdef0123456789ABCDEF", 'key = "', '" then '), (1, 1): ("w" * 19, '" then ', ".")}


def test_odd_rows(odd, nothing):
    labels = sure_findings(odd.select("doc_id", odd["source"].alias("path"), "text"))
    assert scan(odd, labels).count() == 0  # one label is missing, and there are no findings
    assert scan(nothing, labels).count() == 0
