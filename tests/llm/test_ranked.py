import math
import random
import re
from collections import Counter

import duckdb
import pytest

from citespark.llm import ranked as rk

SIGNS = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return SIGNS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    """All scores of all pairs, straight from the contract."""
    counts = [Counter(terms(t)) for _, t in docs]
    total, size = sum(map(bool, counts)), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    found = []
    for i, text in set(items):
        rows = []
        for (d, _), c in zip(docs, counts):
            m = 100 - 75 + (75 * sum(c.values()) * total) // size if size else 1
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                rows.append((-s, d is None, d))
        found += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(rows)[:k])]
    return sorted(found, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(60_000)]
    docs, at = [], 0
    for k in range(1500):
        n = rng.choice([3, 20, 60])
        docs.append((k, " ".join(words[at:at + n]).title() if k % 7 else " ".join(words[at:at + n])))
        at = (at + n) % 59_000
    docs += [(2000 + k, docs[5][1]) for k in range(30)] + [(None, docs[5][1]), (7, docs[9][1])]  # ties
    docs += [(3000, None), (3001, ""), (3002, " -- "), (3003, "w1 " * 40_000), (3004, "wörtlich W2 É")]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 8, 30])))) for k in range(25)]
    return docs, items + [(40, docs[5][1]), (40, docs[5][1]), (40, "w2 w2 w3"), (41, None), (42, "?!"), (43, "É é wörtlich")]


@pytest.mark.parametrize("block_terms, first_share", [(200_000, 0.02), (60, 0.4)])
def test_ranking_is_brute_force(spark, corpus, block_terms, first_share):
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "score").repartition(5)
    got = rk.ranked(df, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"),
                    text_col="score", block_terms=block_terms, first_share=first_share)
    assert rows(got) == brute(docs, items, 10)


def test_buckets_prune_and_lose_nobody():
    """Every document at or above the bound survives each bound; most below it do not."""
    import numpy as np

    rng = np.random.default_rng(1)
    places = [np.sort(rng.choice(300, 20, replace=False)).astype(np.int32) for _ in range(500)]
    impacts = [rng.integers(1, 10**6, 20).astype(np.int32) for _ in range(500)]
    lengths = [math.sqrt(float((v.astype(float) ** 2).sum())) for v in impacts]
    bucket = rk.Bucket(list(range(500)), lengths, [p.tobytes() for p in places], [v.tobytes() for v in impacts], 300)
    weight = np.sort(rng.integers(1, 9000, 25))[::-1].copy()
    where = rng.choice(300, 25, replace=False)
    tail = np.sqrt(np.append(np.cumsum((weight.astype(float) ** 2)[::-1])[::-1], 0))
    every = np.zeros(300, np.int64)
    every[where] = weight
    scores = np.array([(every[p] * v).sum() for p, v in zip(places, impacts)])
    for bound in (1, int(np.sort(scores)[-50]), int(scores.max())):
        got, exact = bucket.search((where, weight, tail), bound)
        assert set(np.flatnonzero(scores >= bound)) <= set(got) and (scores[got] == exact).all()
    assert len(got) < 250
    assert len(bucket.search((where, weight, tail), int(tail[0] * max(lengths)) * 2)[0]) == 0


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    got = rk.ranked(odd, odd.limit(1), item_col="doc_id").collect()
    assert {r["doc_id"] for r in got} >= {1, 2, None} and rk.ranked(nothing, odd.limit(1), item_col="doc_id").count() == 0
    assert rk.ranked(odd, nothing, item_col="doc_id").count() == 0


def test_pieces_of_long_texts_end_between_terms(monkeypatch):
    text = "Ab cd-éf " * 50
    whole = rk.term_counts(text)
    monkeypatch.setattr(rk, "PIECE", 7)
    assert rk.term_counts(text) == whole == {b"ab": 50, b"cd": 50, "éf".encode(): 50}


def test_sql_agrees(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    want = con.execute(rk.SQL).fetchall()
    assert rows(rk.op11(spark, "/root/testdata/sf0.001")) == sorted(want, key=str)
