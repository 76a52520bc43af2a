"""Modularity communities (Louvain) as an iterative DataFrame job that ends by itself.

State is one table of nodes ``(id, parent, k, loop, m2, com, kin, to, gain, active)`` beside symmetric edges ``(src, dst, w)``.
``to`` and ``gain`` are a node's best move and what it adds to modularity (times m2 / 2), ``kin`` the weight of its links
into its own community. A round moves some of the nodes that gain, then scores the active ones anew: movers, their
neighbours, and those that gained but had to wait. All others keep their figures, so the work of a round falls with the
active set. Nodes are chosen by a hash of id and round; a round that does not raise modularity is dropped, and a smaller
share moves instead. The smallest choice lets no two moves share a community: their gains then add up exactly, so
modularity rises with every round that is kept, and no labelling comes twice. A level ends when a scoring of all nodes
finds no gain. Its communities are split into their connected parts before they become the nodes of the next level; the
run ends with a level in which nothing moved. Every round is written to the shared folder: lineage stays short, and a lost
executor costs one round at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from citespark.functions import numbered, ordered_histogram
from citespark.operators.components import connected_components
from citespark.session import cut_lineage

_EPS = 1e-9  # gains are rounded to this, so that summation order cannot change a decision
_NODE = ("id", "parent", "k", "loop", "m2")
_ALONE = 5  # from this share exponent on, no two moves may share a community


@dataclass
class _Round:
    nodes: DataFrame
    q: float  # modularity of the labels, summed over parents
    movers: int  # nodes that would gain
    whole: bool  # all nodes were scored


def _symmetric(edges: DataFrame) -> DataFrame:
    both = edges.where(F.col("src") != F.col("dst")).select(F.explode(F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("_e"), F.col("weight").cast("double").alias("w"))
    return both.groupBy("_e.src", "_e.dst").agg(F.sum("w").alias("w"))


def _scored(nodes: DataFrame, sym: DataFrame, seed: int, whole: bool) -> _Round:
    """The written round: best moves of the active nodes of ``nodes`` (_NODE, com, kin, active)."""
    tot = nodes.groupBy(F.col("com").alias("c")).agg(F.sum("k").alias("tot"))
    nodes = nodes.join(tot.select(F.col("c").alias("com"), F.col("tot").alias("tot_own")), "com")
    busy = nodes.where("active").withColumnRenamed("id", "src")
    look = nodes.select(F.col("id").alias("dst"), F.col("com").alias("c"), F.col("tot_own").alias("tot"))
    own = busy.withColumns({"c": F.col("com"), "tot": F.col("tot_own"), "w": F.lit(0.0)})
    near = sym.join(busy, "src").join(look, "dst").drop("dst")
    row = ["src", *_NODE[1:], "com", "tot_own"]
    kin = near.unionByName(own).groupBy(*row, "c", "tot").agg(F.sum("w").alias("kin_c"))
    mine = F.col("c") == F.col("com")
    others = F.col("tot") - F.when(mine, F.col("k")).otherwise(0.0)
    cand = kin.withColumn("g", F.round(F.col("kin_c") - F.col("k") * others / F.col("m2"), 9))
    best = cand.groupBy(*row).agg(
        F.max(F.struct("g", F.xxhash64("c", F.lit(seed)).alias("h"), "c")).alias("b"),
        F.max(F.when(mine, F.col("g"))).alias("stay"), F.max(F.when(mine, F.col("kin_c"))).alias("kin"))
    best = best.withColumnRenamed("src", "id").select(
        *_NODE, "com", "tot_own", "kin", F.col("b.c").alias("to"), (F.col("b.g") - F.col("stay")).alias("gain"))
    rest = nodes.where("NOT active").select(*_NODE, "com", "tot_own", "kin", F.col("com").alias("to"), F.lit(0.0).alias("gain"))
    seen = Observation()
    quality = (F.col("kin") + F.col("loop")) / F.col("m2") - F.col("k") * F.col("tot_own") / (F.col("m2") * F.col("m2"))
    written = cut_lineage(best.unionByName(rest).observe(
        seen, F.sum(quality).alias("q"), F.count_if(F.col("gain") > _EPS).alias("movers")))
    return _Round(written.drop("tot_own"), seen.get["q"] or 0.0, seen.get["movers"] or 0, whole)


def _chosen(now: _Round, turn: int, seed: int, share: int) -> DataFrame:
    """(id, com) of the moves of this round: one in ``2 ** share``, or those that meet no stronger one in a community."""
    movers = now.nodes.where(F.col("gain") > _EPS)
    spot = F.xxhash64("id", F.lit(turn), F.lit(seed))
    if share < _ALONE:
        return movers.where(F.pmod(spot, F.lit(2**share)) == 0).select("id", F.col("to").alias("com"))
    movers = movers.select("id", "com", "to", F.struct("gain", spot.alias("h"), "id").alias("rank"))
    ends = movers.select(F.explode(F.array("com", "to")).alias("c"), "rank").groupBy("c").agg(F.max("rank").alias("top"))
    for end in ("com", "to"):
        movers = movers.join(ends.withColumnRenamed("c", end), end).where(F.col("rank") == F.col("top")).drop("top")
    return movers.select("id", F.col("to").alias("com"))


def _moved(now: _Round, moves: DataFrame, sym: DataFrame, seed: int) -> _Round:
    moves = moves.select("id", F.col("com").alias("_com"))
    around = sym.join(moves.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    nodes = now.nodes.join(moves, "id", "left").join(around.withColumn("_near", F.lit(True)), "id", "left")
    active = F.col("_com").isNotNull() | F.col("_near").isNotNull() | (F.col("gain") > _EPS)
    return _scored(nodes.select(*_NODE, F.coalesce("_com", "com").alias("com"), "kin", active.alias("active")), sym, seed, False)


def _level(nodes: DataFrame, sym: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """Local moving from ``nodes`` (_NODE, com, kin) until no move of any node gains; the table and the rounds kept."""
    now = _scored(nodes.withColumn("active", F.lit(True)), sym, seed, True)
    turn, dropped, kept = 0, 0, 0
    while True:
        turn += 1
        if not now.movers:
            if now.whole:
                return now.nodes, kept
            now = _scored(now.nodes.select(*_NODE, "com", "kin", F.lit(True).alias("active")), sym, seed, True)
            continue
        # All movers and half of them in turn: of nodes that would swap for ever, the half ends up with the other one.
        share = min(_ALONE, kept % 2 + dropped)
        if now.movers < 2**share:
            share = _ALONE
        after = _moved(now, _chosen(now, turn, seed, share), sym, seed)
        if share == _ALONE or after.q > now.q + 1e-12:
            now, kept, dropped = after, kept + 1, 0
        else:
            dropped += 1


def _communities(nodes: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """``(id, parent, rep)``: nodes with edges and the representative of their community."""
    sym = cut_lineage(_symmetric(edges))
    k = sym.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    linked = nodes.select("id", "parent").join(k, "id")
    m2 = linked.groupBy("parent").agg(F.sum("k").alias("m2"))
    state = cut_lineage(linked.join(m2, "parent").select(*_NODE[:3], F.lit(0.0).alias("loop"), "m2"))
    members = state.select("id", "parent", F.col("id").alias("rep"))
    while True:  # each level but the last has fewer nodes, so this ends
        done, kept = _level(state.withColumns({"com": F.col("id"), "kin": F.lit(0.0)}), sym, seed)
        if not kept:
            return members
        inside = sym
        for end, c in (("src", "_a"), ("dst", "_b")):
            inside = inside.join(done.select(F.col("id").alias(end), F.col("com").alias(c)), end)
        parts = connected_components(done.select("id"), inside.where("_a = _b").select("src", "dst"))
        labels = parts.select(F.col("id").alias("rep"), F.col("component").alias("new"))
        members = cut_lineage(members.join(labels, "rep").select("id", "parent", F.col("new").alias("rep")))
        a = labels.withColumnsRenamed({"rep": "src", "new": "a"})
        b = labels.withColumnsRenamed({"rep": "dst", "new": "b"})
        ends = cut_lineage(sym.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.sum("w").alias("w")))
        within = ends.where("a = b").select(F.col("a").alias("id"), F.col("w").alias("_in"))
        sym = ends.where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
        # the communities are the nodes of the next level
        state = cut_lineage(
            done.join(labels.withColumnRenamed("rep", "id"), "id").groupBy(F.col("new").alias("id"), "parent", "m2")
            .agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).join(within, "id", "left")
            .select("id", "parent", "k", (F.col("loop") + F.coalesce("_in", F.lit(0.0))).alias("loop"), "m2"))


def _by_size(members: DataFrame, name: str) -> DataFrame:
    """Community numbers 1, 2, … inside each parent, largest first, then by smallest member."""
    sizes = members.groupBy("parent", "rep").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_m"))
    if dict(sizes.dtypes)["_m"] in ("bigint", "int", "smallint", "tinyint"):
        placed = numbered(sizes, "_n", "_m", name, ["parent"])
    else:
        neg = sizes.withColumn("_v", -F.col("_n"))
        start = ordered_histogram(neg, "_v", ["parent"]).select("parent", "_v", F.col("before").alias("_s"))
        tie = Window.partitionBy("parent", "_v").orderBy("_m")
        placed = neg.withColumn("_t", F.row_number().over(tie)).join(start, ["parent", "_v"]).withColumn(name, F.col("_s") + F.col("_t"))
    return members.join(placed.select("parent", "rep", name), ["parent", "rep"]).select("id", "parent", name)


def _detect(nodes: DataFrame, edges: DataFrame, name: str, seed: int) -> DataFrame:
    found = _communities(nodes, edges, seed)
    alone = nodes.select("id", "parent").join(found.select("id"), "id", "left_anti").withColumn("rep", F.col("id"))
    return _by_size(found.unionByName(alone), name)


def louvain(nodes: DataFrame, edges: DataFrame, seed: int = 1337) -> DataFrame:
    """``(id, com)``: communities numbered by size. ``nodes(id)``, ``edges(src, dst, weight)``."""
    flat = nodes.select("id").distinct().withColumn("parent", F.lit(0).cast("long"))
    return _detect(flat, edges, "com", seed).select("id", "com")


def louvain_two_level(nodes: DataFrame, edges: DataFrame, seed: int = 1337) -> DataFrame:
    """``(id, com, com2)``: a second run inside each community, all communities in one job."""
    first = cut_lineage(louvain(nodes, edges, seed))
    return sub_communities(first, edges, seed)


def sub_communities(labels: DataFrame, edges: DataFrame, seed: int = 1337) -> DataFrame:
    """``(id, com, com2)`` for given ``labels(id, com)``: edges between communities are left out."""
    inside = edges
    for end, c in (("src", "_a"), ("dst", "_b")):
        inside = inside.join(labels.select(F.col("id").alias(end), F.col("com").alias(c)), end)
    inside = inside.where(F.col("_a") == F.col("_b")).select("src", "dst", "weight")
    nodes = labels.select("id", F.col("com").alias("parent"))
    return _detect(nodes, inside, "com2", seed).select("id", F.col("parent").alias("com"), "com2")
