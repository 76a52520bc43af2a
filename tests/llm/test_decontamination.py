import random

import duckdb
import pytest

from citespark.llm import decontamination as dec


def weights(items):
    holders = {}
    for k, w in enumerate(items):
        for g in {tuple(w[i:i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)}:
            holders.setdefault(g, set()).add(k)
    return {g: max(1, int(16 / len(h) + 0.5)) for g, h in holders.items()}


def brute(docs, items):
    """Best similarity over all windows, by bags of weighted 5-grams."""
    from collections import Counter

    known, found = weights(list(dict.fromkeys(tuple(t.lower().split()) for _, t in items))), {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            own = item.lower().split()
            n = len(own)
            size = min(5, n)
            bag = Counter(tuple(own[k:k + size]) for k in range(n - size + 1))
            for start in range(len(words) - n + 1):
                window = Counter(tuple(words[k:k + size]) for k in range(start, start + n - size + 1))
                both = sum(known.get(g, 16) * min(c, window[g]) for g, c in bag.items())
                total = sum(known.get(g, 16) * c for b in (bag, window) for g, c in b.items()) - both
                if 5 * both >= 4 * total and both / total > found.get((d, i), (0, 0))[0]:
                    found[d, i] = (both / total, start)
    return sorted((d, i, round(s, 9)) for (d, i), (s, _) in found.items())


def rows(df):
    return sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in df.collect())


@pytest.mark.parametrize("broadcast", [dec.BROADCAST_ROWS, 0])
def test_planted_windows_are_brute_force(spark, broadcast):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([3, 5, 12, 30, 30, 60])]
    items.append((9, items[3][1]))  # a repeated text under another id
    docs = []
    for k in range(40):
        words = rng.choices(vocabulary, k=rng.choice([20, 80]))
        for _ in range(rng.choice([0, 1, 2])):
            copy = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(copy))
                rng.choice([lambda: copy.insert(at, "odd"), lambda: copy.__setitem__(at, "odd"),
                            lambda: copy.__delitem__(at)])()
            at = rng.randrange(len(words))
            words[at:at] = copy
        docs.append((k, " ".join(words)))
    got = dec.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast)
    assert rows(got) == brute(docs, items)


def test_sql_form(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = dec.op8(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(dec.SQL).fetchall()) and got.count() > 0


def test_odd_rows(spark, odd, nothing):
    item = "brown fox jumps over the lazy dog and runs far away into the deep"
    bench = spark.createDataFrame([(1, item, 5), (1, item, 6), (2, None, 1), (3, "", 1), (None, "one two", 1)],
                                  "item_id long, text string, h int")
    got = dec.contaminated(odd, bench)
    assert sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=str) == [
        (1, 1), (2, 1), (7, None), (None, 1)]
    assert dec.contaminated(nothing, bench).count() == dec.contaminated(odd, bench.where("false")).count() == 0
    with pytest.raises(ValueError):
        dec.contaminated(odd, bench, radius=64)


@pytest.mark.parametrize("broadcast", [dec.BROADCAST_ROWS, 0])
def test_documents_shorter_than_the_item(spark, broadcast):
    """An item less its last words is one window, if it is long enough for the threshold."""
    item = [f"w{k}" for k in range(40)]
    docs = [(0, " ".join(item[:39])), (1, " ".join(item[3:])), (2, " ".join(item[:20])), (None, " ".join(item[1:]))]
    got = dec.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(
        [(7, " ".join(item))], "item_id long, text string"), broadcast_rows=broadcast)
    assert sorted(((r["doc_id"], round(r["similarity"], 6), r["start"], r["n_words"]) for r in got.collect()), key=str) == [
        (0, round(35 / 36, 6), 0, 39), (1, round(33 / 36, 6), 0, 37), (None, round(35 / 36, 6), 0, 39)]


@pytest.mark.parametrize("broadcast", [dec.BROADCAST_ROWS, 0])
def test_templates_weigh_less(spark, broadcast):
    """Items of two prompt templates: bodies decide, and the best window may start at an unshared shingle."""
    templates = [[f"t{t}x{k}" for k in range(30)] for t in range(2)]
    bodies = [[f"b{k}x{j}" for j in range(60)] for k in range(24)]
    items = [(k, " ".join(templates[k // 12] + bodies[k])) for k in range(24)]
    odd = [f"odd{k}" for k in range(40)]
    docs = [(0, " ".join(templates[1] + bodies[2])), (1, " ".join(templates[0] + bodies[3])),
            (2, " ".join(odd[:15] + templates[1] + bodies[5] + odd[15:])), (3, " ".join(templates[0] + odd)),
            (4, " ".join(templates[0] + templates[1] + bodies[14] + templates[1] + bodies[7])),
            (5, " ".join(odd[:9] + templates[0][:20] + bodies[16][:57] + templates[1] + bodies[4] + odd))]
    got = dec.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast)
    found = rows(got)
    assert found == brute(docs, items) and {(0, 2), (2, 5)} <= {r[:2] for r in found}
