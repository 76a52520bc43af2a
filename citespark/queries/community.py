"""Community detection: labels checked by what SQL can state of them, and exactly where the communities are planted."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.operators import community as cm
from citespark.operators.components import connected_components
from citespark.queries import query


def _graph(c):
    return c.pubs_dense.select(F.col("XX").alias("id")), c.bib_edges


def _facts(labels: DataFrame, edges: DataFrame, com: str, parent: str | None = None) -> DataFrame:
    """Per node: its labels, whether its community is connected, and whether joining it to another would gain.

    Computed from labels and edges alone. With ``parent``, only edges inside a parent count.
    """
    top = F.col(parent) if parent else F.lit(0)
    own = labels.select("id", top.alias("p"), F.struct(top, com).alias("c"))
    ends = edges.where("src != dst").select("src", "dst", F.col("weight").cast("double").alias("w"))
    for end, p, k in (("src", "p", "a"), ("dst", "q", "b")):
        ends = ends.join(own.select(F.col("id").alias(end), F.col("p").alias(p), F.col("c").alias(k)), end)
    ends = ends.where("p = q")
    degree = ends.select("p", F.explode(F.array("a", "b")).alias("c"), "w").groupBy("p", "c").agg(F.sum("w").alias("tot"))
    m2 = degree.groupBy("p").agg(F.sum("tot").alias("m2"))
    pair = ends.where("a != b").groupBy("p", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
    pair = pair.join(m2, "p")
    for k in "ab":
        pair = pair.join(degree.select(F.col("c").alias(k), F.col("tot").alias(f"tot_{k}")), k)
    gains = pair.where("w - tot_a * tot_b / m2 > 1e-6").select(F.explode(F.array("a", "b")).alias("c")).distinct()
    parts = connected_components(own.select("id"), ends.where("a = b").select("src", "dst"))
    parts = own.join(parts, "id").groupBy("c").agg(F.count_distinct("component").alias("parts"))
    count = own.groupBy("id").agg(F.count("*").alias("n_labels"))
    return own.join(parts, "c").join(gains.withColumn("g", F.lit(True)), "c", "left").join(count, "id").select(
        "id", "n_labels", (F.col("parts") == 1).alias("connected"), F.col("g").isNotNull().alias("merge_gains"))


@query("louvain", "SELECT XX AS id, CAST(1 AS BIGINT) AS n_labels, true AS connected, false AS merge_gains FROM pubs_dense")
def _(c):
    """Every node has one label, every community is connected, and no two communities would gain by joining."""
    nodes, edges = _graph(c)
    return _facts(cm.louvain(nodes, edges), edges, "com")


@query("louvain_two_level", """SELECT XX AS id, CAST(1 AS BIGINT) AS n_labels, true AS connected, false AS merge_gains
    FROM pubs_dense""")
def _(c):
    """The same of the sub-communities, each network being the inside of a community of the first level."""
    nodes, edges = _graph(c)
    return _facts(cm.louvain_two_level(nodes, edges), edges, "com2", "com")


@query("louvain_planted", """WITH g AS (SELECT c_custkey // 8 AS g, count(*) AS n, min(c_custkey) AS m FROM customer GROUP BY 1),
    p AS (SELECT g, row_number() OVER (ORDER BY n DESC, m) AS com FROM g)
    SELECT c_custkey AS id, com, CAST(1 AS BIGINT) AS com2 FROM customer JOIN p ON c_custkey // 8 = g""")
def _(c):
    """Groups of eight customers whose members are all linked: communities and their numbers are known."""
    own = c.table("customer").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 8").alias("g"))
    edges = own.join(own.withColumnRenamed("src", "dst"), "g").where("src < dst").select("src", "dst", F.lit(1).alias("weight"))
    found = cm.louvain_two_level(own.select(F.col("src").alias("id")), edges)
    return found.select("id", F.col("com").cast("long").alias("com"), F.col("com2").cast("long").alias("com2"))
