import zlib

from pyspark.sql import functions as F

from citespark.llm.language import Grams, identify, op4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = op4(spark, sf).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"] and r["n"] >= 20] if "n" in rows[0] else [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.98 * len(out) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd, nothing):
    train = spark.createDataFrame([("en", "the and of to in that"), ("de", "der und die nicht für"), (None, "x"), ("fr", None)],
                                  "lang string, text string")
    got = {(r["doc_id"], r["lang_pred"]) for r in identify(odd, train).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= got and (1, "en") in got
    assert {p for _, p in got} <= {"en", "de", "und"}
    assert identify(odd, train).count() == odd.count() and identify(nothing, train).count() == 0
    none = identify(odd, train.where("false")).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in none} == {("und", 0.0, True)}
    far = identify(spark.createDataFrame([(1, "zzzz qqqq xxxx")], "doc_id int, text string"), train).first()
    assert far["rejected"] and far["lang_pred"] in ("en", "de")


def test_pieces_of_a_text_count_like_the_whole(monkeypatch):
    from citespark.llm import language

    text = "Ein Satz, der -- mit Zeichen 12 und Lücken -- lang genug ist. " * 9
    whole = Grams(1 << 12).counts(text)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language, "CHUNK", size)
        part = Grams(1 << 12).counts(text)
        assert part[0].tolist() == whole[0].tolist() and part[1].tolist() == whole[1].tolist(), size
