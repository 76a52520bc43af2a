"""Ranks, quantiles, numbering, pairs and nesting against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citespark import functions as fn


def _values(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")


@pytest.mark.parametrize("p", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])
def test_quantile_is_type_seven(spark, p):
    values = [random.Random(7).choice([-3.5, 0, 1, 2, 2, 10, 1e6, 1e-9]) for _ in range(101)]
    got = fn.quantiles(_values(spark, values), "v", p).first()["q"]
    assert got == pytest.approx(np.quantile(values, p))


def test_quantile_of_the_textbook_case(spark):
    assert fn.quantiles(_values(spark, [1, 2, 2, 10]), "v", 0.25).first()["q"] == 1.75


def test_scalar_quantile_in_a_filter(spark):
    df = _values(spark, range(10))
    assert df.where(F.col("v") > fn.scalar_quantile(df, "v", 0.5)).count() == 5


def test_percent_and_average_ranks(spark):
    df = _values(spark, [1, 2, 2, 10])
    pr = [r["percent_rank"] for r in fn.percent_ranks(df, "v").orderBy("id").collect()]
    assert pr == pytest.approx([0, 1 / 3, 1 / 3, 1])
    ar = [r["avg_rank"] for r in fn.average_ranks(df, "v").orderBy("id").collect()]
    assert ar == [1, 2.5, 2.5, 4]


def test_ranks_by_group_with_a_hot_value(spark):
    rng = random.Random(3)
    rows = [(g, i, 5.0 if rng.random() < 0.5 else rng.uniform(-9, 9)) for i in range(400) for g in ("x", "y")]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = {(r["g"], r["id"]): r["percent_rank"] for r in fn.percent_ranks(df, "v", ["g"]).collect()}
    for g in ("x", "y"):
        vals = [v for h, _, v in rows if h == g]
        for h, i, v in rows:
            if h == g:
                assert got[(g, i)] == pytest.approx(sum(w < v for w in vals) / (len(vals) - 1))


def test_numbering_is_global_and_ties_go_by_id(spark):
    rng = random.Random(5)
    rows = [(i * 40000, rng.choice([1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = [(r["id"], r["rn"]) for r in fn.numbered(df, "v", "id").collect()]
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert dict(got) == want


def test_ties_kept_or_cut(spark):
    df = _values(spark, [3, 3, 2])
    order = [F.col("v").desc()]
    assert fn.top_per_group(df.withColumn("g", F.lit(1)), ["g"], order, 1, ties=True).count() == 2
    assert fn.top_per_group(df.withColumn("g", F.lit(1)), ["g"], [*order, F.col("id")], 1).count() == 1


def _brute(rows, k):
    items = {}
    for m, i in rows:
        items.setdefault(i, set()).add(m)
    c = Counter()
    for members in items.values():
        c.update(itertools.combinations(sorted(members), 2))
    return {p: n for p, n in c.items() if n >= k}


@pytest.mark.parametrize("k", [1, 2, 3, 4])
@pytest.mark.parametrize("block", [4000, 7, 3])
def test_pairs_with_hot_items_are_whole_and_exact(spark, k, block):
    rng = random.Random(k)
    rows = {(m, rng.randrange(60)) for m in range(45) for _ in range(6)}
    rows |= {(m, 100 + h) for m in range(45) for h in range(4) if rng.random() < 0.8}  # held by most members
    twice = sorted(rows) + sorted(rows)[::7] + [(None, 3), (4, None)]  # repeats count once, nulls not at all
    df = spark.createDataFrame(twice, "m long, i long")
    got = fn.shared_item_pairs(df, "m", "i", k, block=block).collect()
    assert len(got) == len({(r["src"], r["dst"]) for r in got})
    assert {(r["src"], r["dst"]): r["weight"] for r in got} == _brute(rows, k)


@pytest.mark.parametrize("k", [2, 4])
@pytest.mark.parametrize("block, hot", [(4000, 12), (9, 5), (4, 20)])
def test_pairs_with_held_items_and_wide_members(spark, k, block, hot):
    rng = random.Random(k)
    rows = {(f"m{m}", rng.randrange(60)) for m in range(45) for _ in range(5 if m else 40)}
    rows |= {(f"m{m}", 100 + h) for m in range(45) for h in range(4) if rng.random() < 0.3 + 0.2 * h}
    got = fn.shared_item_pairs(spark.createDataFrame(sorted(rows), "m string, i long"), "m", "i", k, block=block, hot=hot).collect()
    assert len(got) == len({(r["src"], r["dst"]) for r in got})
    assert {(r["src"], r["dst"]): r["weight"] for r in got} == _brute(rows, k)


def test_pairs_below_the_cut_are_neither_written_nor_counted_in_one_task(spark, monkeypatch):
    from citespark.functions import pairs

    written, cut = [], pairs.cut_lineage
    monkeypatch.setattr(pairs, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(pairs, "PAIRS_OF_A_TASK", 500, raising=False)
    rng = random.Random(5)
    rows = {(m, rng.randrange(300)) for m in range(600) for _ in range(12)}
    got = fn.shared_item_pairs(spark.createDataFrame(sorted(rows), "m long, i long"), "m", "i", 3)
    want = _brute(rows, 1)
    assert {(r["src"], r["dst"]): r["weight"] for r in got.collect()} == {p: n for p, n in want.items() if n >= 3}
    assert max(df.count() for df in written) <= len(rows) < len(want)
    assert got.rdd.getNumPartitions() > 100


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "m long, i long")
    assert fn.shared_item_pairs(df, "m", "i", 2).count() == 0


def test_nest_has_one_row_per_group_and_keeps_nulls(spark):
    rows = [("hot", i) for i in range(100)] + [("cold", i) for i in range(3)] + [(None, 7), (None, 8)]
    df = spark.createDataFrame(rows, "g string, x long")
    nested = fn.nest(df, ["g"], "xs")
    assert {r["g"]: len(r["xs"]) for r in nested.collect()} == {"hot": 100, "cold": 3, None: 2}
    assert sorted(map(str, map(tuple, fn.unnest(nested, "xs").collect()))) == sorted(map(str, rows))


def test_ranks_and_numbers_keep_rows_with_nulls(spark):
    df = spark.createDataFrame(
        [("a", 3.0, 1), ("a", None, 2), ("a", float("inf"), 3), (None, 1.0, 4), (None, None, None)],
        "g string, v double, i long")
    ranks = {(r["g"], r["i"]): r["percent_rank"] for r in fn.percent_ranks(df, "v", ["g"]).collect()}
    assert ranks == {("a", 1): 0.0, ("a", 2): None, ("a", 3): 1.0, (None, 4): 0.0, (None, None): None}
    assert fn.average_ranks(df, "v").count() == 5
    numbers = {(r["g"], r["i"]): r["rn"] for r in fn.numbered(df, "v", "i", by=["g"]).collect()}
    assert numbers == {("a", 3): 1, ("a", 1): 2, ("a", 2): 3, (None, 4): 1, (None, None): 2}
    assert sorted(r["rn"] for r in fn.numbered(df, "v", "i").collect()) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("cap", [2, 1000, 1001])
def test_cap_is_one_rule_for_every_size(spark, cap):
    from citespark.operators.corpus import cap_per_batch

    rows = [(1, i) for i in range(1200)] + [(2, None), (2, 5)]
    df = spark.createDataFrame(rows, "batch long, XX long")
    got = cap_per_batch(df, cap).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in got} == {1: min(cap, 1200), 2: 2}


def test_country_names_of_any_length(spark):
    from citespark.operators.cleaning import author_countries

    aff = spark.createDataFrame([("p", "Univ Kinshasa, Democratic Republic of the Congo"), ("q", "Abidjan, Cote d'Ivoire.")],
                                "EID string, C1 string")
    names = spark.createDataFrame([("Democratic Republic of the Congo",), ("Cote d'Ivoire",), ("Chad",)], "country string")
    got = {r["EID"]: r["AU_CO"] for r in author_countries(aff, names).collect()}
    assert got == {"p": "Democratic Republic of the Congo", "q": "Cote d'Ivoire"}


def test_expansion_from_seeds_by_blocks(spark):
    from citespark.functions.pairs import dealt

    rng = random.Random(3)
    rows = sorted({(p, rng.randrange(6)) for p in range(60) for _ in range(2)})
    cites = spark.createDataFrame(rows, "EID long, SID long")
    seeds = cites.where("EID < 20").withColumnRenamed("EID", "seed")
    left, right = dealt(seeds, cites, "SID", "seed", "EID", block=4)
    got = left.join(right, ["SID", "_l", "_r"]).select("seed", "EID", "SID").collect()
    want = [(a, b, x) for a, x in rows if a < 20 for b, y in rows if x == y]
    assert sorted(map(tuple, got)) == sorted(want)


def test_column_rules(spark):
    df = spark.createDataFrame([("  a  b; ", "[No abstract available]", "NULL", "numeric()", "Smith J.A.")], "a string, b string, c string, d string, e string")
    row = df.select(
        fn.strip_trailing_sep(fn.squish("a")), *[fn.normalize_missing(c) for c in "bcd"], fn.clean_author("e"),
        fn.truncate_text(F.lit("x" * 50), 45), fn.truncate_text(F.lit("x" * 45), 45)).first()
    assert tuple(row) == ("a b", None, None, None, "Smith J", "x" * 42 + "...", "x" * 45)


def test_author_labels(spark):
    df = spark.createDataFrame([([],), (["A"],), (["A", "B"],), (["A", "B", "C"],)], "au array<string>")
    assert [r[0] for r in df.select(fn.first_author_label("au")).collect()] == [None, "A", "A & B", "A et al."]


def test_periods(spark):
    df = spark.createDataFrame([(1989,), (1990,), (2019,), (2020,)], "y long")
    assert [r[0] for r in df.select(fn.period_of("y")).collect()] == [1, 2, 4, None]


def test_tc_per_year_never_divides_by_zero(spark):
    df = spark.createDataFrame([(10, 2024), (10, 2025)], "TC long, PY long")
    assert [r[0] for r in df.select(fn.tc_per_year("TC", "PY", 2024)).collect()] == [10.0, None]
