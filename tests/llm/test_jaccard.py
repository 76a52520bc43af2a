import random

import pytest

from citespark.llm.components import components
from citespark.llm.jaccard import choose_bands, jaccard_classes


def grams(text):
    words = (text or "").split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = [grams(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j]
             and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        stack, seen = [i], {i}
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        label[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return [(d, label[i], len(near[i])) for i, (d, _) in enumerate(rows)]


def got(df, **more):
    return sorted(str((r["doc_id"], r["class_id"], r["n_links"])) for r in jaccard_classes(df, **more).collect())


@pytest.mark.parametrize("block", [512, 7])
def test_planted_groups_are_brute_force(spark, block):
    """A group of near copies larger than a block, chains, copies and loners."""
    rng, rows = random.Random(4), []
    vocabulary = [f"w{k}" for k in range(3000)]
    for base in range(6):
        words = rng.choices(vocabulary, k=rng.choice([60, 120]))
        for _ in range(30 if base == 0 else 6):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [" ".join(rng.choices(vocabulary, k=50)) for _ in range(40)] + rows[:5] * 4 + ["a b", "a b", "a", "", None]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, block_rows=block) == sorted(map(str, brute(rows)))


def test_small_table_is_brute_force(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert got(small) == sorted(map(str, brute(rows)))


def test_odd_rows(odd, nothing):
    assert jaccard_classes(odd).count() == odd.count()
    by_id = {r["doc_id"]: r for r in jaccard_classes(odd.where("doc_id IS NOT NULL")).collect()}
    assert by_id[2]["class_id"] == 1 and by_id[1]["n_copies"] == 2 and by_id[4]["n_links"] == 0
    assert jaccard_classes(nothing).count() == 0


def test_bands_reach_their_recall():
    for recall in (0.9, 0.99, 0.999):
        bands, rows = choose_bands(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 128


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == {
        **{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_write_few_files(spark, monkeypatch):
    """A small stage table is not cut into a file for each shuffle partition."""
    import glob

    from citespark import session

    made, plain = [], session.fresh_path
    monkeypatch.setattr(session, "fresh_path", lambda *a: made.append(plain(*a)) or made[-1])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.range(400).selectExpr("id a", "id - id % 10 b")
    try:
        for key, value in zip(kept, ("60", "false")):
            spark.conf.set(key, value)
        rows = components(edges, 400).collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert {r["node"]: r["component"] for r in rows} == {k: k - k % 10 for k in range(400)}
    assert len(made) > 2 and max(len(glob.glob(f"{path}/part-*")) for path in made) <= 8
