"""Networks: hand fixtures and properties."""

import itertools

import pytest
from pyspark.sql import functions as F

from citespark.operators import community as cm
from citespark.operators.components import connected_components
from citespark.operators import network as nw


def _pairs(df, value="weight"):
    return {(r["src"], r["dst"]): r[value] for r in df.collect()}


def cliques(groups, links=(), weight=1):
    rows = [(a, b, weight) for g in groups for a, b in itertools.combinations(g, 2)]
    return rows + list(links)


@pytest.fixture(scope="module")
def two(spark):
    rows = cliques([range(5), range(5, 10)], [(0, 5, 1)])
    return spark.range(10), spark.createDataFrame(rows, "src long, dst long, weight long")


def test_tiny_coupling_and_cocitation(tiny):
    assert _pairs(nw.bib_coupling(tiny)) == {("a", "b"): 2, ("b", "c"): 1}
    assert _pairs(nw.co_citation(tiny))[(2, 3)] == 2
    assert _pairs(nw.bib_coupling(tiny, min_weight=2)) == {("a", "b"): 2}


def test_tiny_jaccard_and_isolates(spark, tiny):
    nr = tiny.groupBy(F.col("EID").alias("XX")).agg(F.count("*").alias("NR"))
    edges = nw.bib_coupling(tiny)
    assert _pairs(nw.coupling_jaccard(edges, nr)) == {("a", "b"): 0.5, ("b", "c"): 0.333}
    nodes = nr.select(F.col("XX").alias("id"))
    assert nw.drop_isolates(nodes, edges).count() == 3
    assert {r["id"]: r["dgr"] for r in nw.weighted_degree(edges, nodes).collect()} == {"a": 2, "b": 3, "c": 1, "d": 0}


def test_strengths_add_up_to_twice_the_weights(two):
    _, edges = two
    assert nw.weighted_degree(edges).agg(F.sum("dgr")).first()[0] == 2 * edges.agg(F.sum("weight")).first()[0]


def test_simplify(spark):
    raw = spark.createDataFrame([(1, 1, 5), (1, 2, 2), (2, 1, 3)], "src long, dst long, weight long")
    assert _pairs(nw.simplify_graph(raw)) == {(1, 2): 5}
    assert _pairs(nw.simplify_graph(raw, "max")) == {(1, 2): 3}


def test_loops_count_twice_in_the_community_strength(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 2)], "com long, N long")
    edges = spark.createDataFrame([(1, 1, 4), (1, 2, 4)], "src long, dst long, weight long")
    n, e = nw.community_density_weight(nodes, edges)
    assert {r["com"]: r["dgr"] for r in n.collect()} == {1: 300.0, 2: 100.0}
    assert _pairs(e) == {(1, 1): 100.0, (1, 2): 100.0}


def test_small_subcommunities_are_blanked_not_dropped(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 2, 1)], "id long, com long, com2 long")
    edges = spark.createDataFrame([(1, 2, 1), (3, 4, 9)], "src long, dst long, weight long")
    kept, inner = nw.community_size_filter(labels, edges, 2, 2)
    assert {r["id"]: (r["com"], r["com2"], r["dgr"]) for r in kept.collect()} == {1: (1, 1, 1.0), 2: (1, 1, 1.0), 3: (1, None, 0.0)}
    assert inner.count() == 1


def test_modularity_of_two_cliques(spark, two):
    nodes, edges = two
    labels = nodes.withColumn("com", F.when(F.col("id") < 5, 1).otherwise(2))
    assert nw.modularity(labels, edges).first()["modularity"] == pytest.approx(19 / 42)


def test_louvain_finds_cliques_whatever_the_partitions(spark, two):
    nodes, edges = two
    nodes = nodes.unionByName(spark.createDataFrame([(77,)], "id long"))
    seen = []
    for n in ("1", "8"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            seen.append({r["id"]: r["com"] for r in cm.louvain(nodes, edges.repartition(int(n))).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == {**{i: 1 for i in range(5)}, **{i: 2 for i in range(5, 10)}, 77: 3}


def test_louvain_two_levels(spark):
    small = [range(k * 6, k * 6 + 6) for k in range(4)]
    rows = cliques(small, weight=20)
    rows += [(a, b, 3) for a in small[0] for b in small[1]] + [(a, b, 3) for a in small[2] for b in small[3]]
    rows += [(0, 12, 1)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight long")
    first = spark.range(24).withColumn("com", F.when(F.col("id") < 12, 1).otherwise(2))
    got = {r["id"]: (r["com"], r["com2"]) for r in cm.sub_communities(first, edges).collect()}
    for k, group in enumerate(small):
        assert {got[i] for i in group} == {(1 + k // 2, 1 + k % 2)}


def test_louvain_with_text_ids(spark):
    rows = [(f"n{a}", f"n{b}", w) for a, b, w in cliques([range(4), range(4, 9)])]
    edges = spark.createDataFrame(rows, "src string, dst string, weight long")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(9)], "id string")
    got = {r["id"]: r["com"] for r in cm.louvain(nodes, edges).collect()}
    assert {got[f"n{i}"] for i in range(4)} == {2} and {got[f"n{i}"] for i in range(4, 9)} == {1}


def test_merge_node_universe(spark):
    names = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    nodes = spark.createDataFrame([(1, 4.0), (2, 8.0)], "id long, dgr double")
    assert {r["id"]: r["size"] for r in nw.merge_node_universe(names, nodes).collect()} == {1: 0.5, 2: 1.0, 3: 0.0}


def test_historiograph_keeps_ties(spark):
    direct = spark.createDataFrame([(9, 1), (8, 1), (9, 2), (8, 2), (9, 3)], "src long, dst long")
    nodes, _ = nw.historiograph_top(direct, 1)
    assert {r["id"] for r in nodes.collect()} == {1, 2}


def test_louvain_recovers_a_planted_partition(spark):
    """2,000 nodes in 20 groups, eight links inside and two outside a node: modularity is that of the plan or better."""
    import random

    rng = random.Random(4)
    rows = [(v, (rng.randrange(100) * 20 + v % 20) if k < 8 else rng.randrange(2000), 1) for v in range(2000) for k in range(10)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight long").where("src != dst").cache()
    labels = cm.louvain(spark.range(2000), edges).cache()
    plan = spark.range(2000).withColumn("com", F.col("id") % 20)
    q = [nw.modularity(x, edges).first()["modularity"] for x in (labels, plan)]
    assert q[0] > q[1] - 0.01
    inside = edges
    for end, c in (("src", "a"), ("dst", "b")):
        inside = inside.join(labels.select(F.col("id").alias(end), F.col("com").alias(c)), end)
    parts = connected_components(labels.select("id"), inside.where("a = b").select("src", "dst"))
    assert parts.join(labels, "id").groupBy("com").agg(F.count_distinct("component").alias("n")).where("n > 1").count() == 0


def test_a_community_that_falls_apart_is_split(spark, monkeypatch):
    """Moving is replaced by one label for all: the parts that no edge ties together come out apart."""
    edges = spark.createDataFrame(cliques([range(3), range(10, 14)])[:9], "src long, dst long, weight long").where("(src < 5) = (dst < 5)")
    level = cm._level

    def one_label(nodes, sym, seed, calls=[]):
        calls.append(1)
        return (nodes.withColumn("com", F.lit(0).cast("long")), 1) if len(calls) == 1 else level(nodes, sym, seed)

    monkeypatch.setattr(cm, "_level", one_label)
    got = {r["id"]: r["com"] for r in cm.louvain(edges.select(F.col("src").alias("id")).union(edges.select("dst")), edges).collect()}
    assert len({got[i] for i in got if i < 5}) == 1 and not {got[i] for i in got if i < 5} & {got[i] for i in got if i > 5}


def test_connected_components(spark):
    rows = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 101), (7, 5), (200, 999)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in [*range(61), 100, 101, 200, 300, 300]], "id long")
    got = {r["id"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 200: 200, 300: 300}


def test_louvain_without_edges(spark):
    edges = spark.createDataFrame([], "src long, dst long, weight long")
    assert sorted(map(tuple, cm.louvain(spark.range(3), edges).collect())) == [(0, 1), (1, 2), (2, 3)]
