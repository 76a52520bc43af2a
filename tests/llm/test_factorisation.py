import math

import numpy as np

from citespark.llm import factorisation as fm


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    linear, factors, places = rng.normal(size=50), rng.normal(size=(50, 4)), np.array([2, 3, 11, 40])
    values = rng.normal(size=4)
    pairs = sum(factors[places[a]] @ factors[places[b]] * values[a] * values[b] for a in range(4) for b in range(a + 1, 4))
    assert fm.machine(places, values, 0.5, linear, factors) == np.float64(0.5 + linear[places] @ values + pairs).round(12) or \
        math.isclose(fm.machine(places, values, 0.5, linear, factors), 0.5 + linear[places] @ values + pairs, rel_tol=1e-9)


def test_features_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Über alle GIPFELN ist Ruh ruh ruh!!\n| a | b\n" * 30
    whole = fm.features(text, 3, 1 << 10)
    monkeypatch.setattr(fm, "PIECE", 11)
    assert all((a == b).all() for a, b in zip(whole, fm.features(text, 3, 1 << 10)))
    assert len(fm.features(None, None, 8)[0]) == len(fm.STATISTICS)


def test_pairs_are_learned(spark):
    """The label is an exclusive or of two words: no weight alone tells it, their interaction does."""
    words = [("ja" if a else "so") + (" doch" if b else " eben") for a in (0, 1) for b in (0, 1)]
    docs = spark.createDataFrame([(k, words[k % 4], 10) for k in range(400)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, int(k % 4 in (1, 2))) for k in range(200)], "doc_id long, label int")
    got = fm.classify(docs, labels, epochs=60).collect()
    assert sum(r["predicted"] == int(r["doc_id"] % 4 in (1, 2)) for r in got) == 400


def test_held_out_accuracy_and_same_scores(spark):
    made = [{r["doc_id"]: r for r in fm.op13(spark, "/root/testdata/sf0.01").collect()} for _ in range(2)]
    assert made[0] == made[1]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(made[0][r["doc_id"]]["predicted"], r["quality"]) for r in labels if made[0][r["doc_id"]]["held_out"]]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(a == 1 for a, b in held if b == 1)


def test_odd_rows_and_few_labels(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (7, 1), (None, 0), (3, 1), (8, 0), (9, 2)], "doc_id long, label int")
    got = fm.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in fm.classify(odd, labels.where("label = 1 AND doc_id < 3")).collect()} == {1.0}
    assert {r["score"] for r in fm.classify(odd, labels.where("label = 9")).collect()} == {0.5}
    assert fm.classify(nothing, labels).count() == 0
