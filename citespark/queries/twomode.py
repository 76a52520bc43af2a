"""Period and two-mode networks."""

from pyspark.sql import functions as F

from citespark.adapter import VIEWS
from citespark.functions import period_of
from citespark.operators import series as se
from citespark.operators import twomode as tm
from citespark.queries import query
from citespark.queries.series import BOUNDS, CIT_SUMS, CITED_BOUNDS, doc_nodes, period_sql, r6, two_mode

TOPIC_BOUNDS = (2004, 2010, 2016, 2020)

VIEWS["bib_ep"] = """SELECT e.*, a.com AS com1, b.com AS com2, a.PY AS PY1, b.PY AS PY2, a.P AS P1, b.P AS P2 FROM bib_edges e
    JOIN bib_nodes a ON e.src = a.XX JOIN bib_nodes b ON e.dst = b.XX"""
VIEWS["cit_ep"] = """SELECT e.*, a.com AS com1, b.com AS com2, a.PY AS PY1, b.PY AS PY2, a.P AS P1, b.P AS P2 FROM cit_edges e
    JOIN cit_nodes a ON e.src = a.SID JOIN cit_nodes b ON e.dst = b.SID"""
BETWEEN = """SELECT least(com1, com2) AS com1, greatest(com1, com2) AS com2, P1 AS P, CAST(sum(weight) AS BIGINT) AS weight_sum
    FROM {} WHERE P1 = P2 AND com1 <> com2 GROUP BY 1, 2, 3"""
VIEWS["p2"] = f"""SELECT *, weight_adj / max(weight_adj) OVER () AS weight FROM (SELECT b.*, CAST(weight_sum AS DOUBLE) / (x.n * y.n) AS weight_adj
    FROM ({BETWEEN.format('bib_ep')}) b JOIN bib_panel x ON b.com1 = x.com AND b.P = x.P JOIN bib_panel y ON b.com2 = y.com AND b.P = y.P)"""
VIEWS["p4"] = f"""WITH b AS ({BETWEEN.format('cit_ep')}), d AS (SELECT com, P, sum(w) AS dgr FROM (SELECT com1 AS com, P, weight_sum AS w FROM b
    UNION ALL SELECT com2, P, weight_sum FROM b) GROUP BY 1, 2)
    SELECT *, weight_adj / max(weight_adj) OVER () AS weight FROM (SELECT b.*, CAST(weight_sum AS DOUBLE) / (x.dgr + y.dgr - weight_sum) AS weight_adj
    FROM b JOIN d x ON b.com1 = x.com AND b.P = x.P JOIN d y ON b.com2 = y.com AND b.P = y.P)"""
VIEWS["p5"] = f"""SELECT com_bib, com_cit, PY, c AS weight_count, coalesce(CASE WHEN a + b - c > 0 THEN CAST(c AS DOUBLE) / (a + b - c) END, 0) AS weight,
    {period_sql('PY', BOUNDS)} AS P FROM (SELECT *, sum(c) OVER (PARTITION BY com_bib, PY) AS a, sum(c) OVER (PARTITION BY com_cit, PY) AS b FROM
    (SELECT g.*, coalesce(k.c, 0) AS c FROM (SELECT * FROM (SELECT DISTINCT com_bib FROM two_mode), (SELECT DISTINCT com_cit FROM two_mode), (SELECT DISTINCT PY FROM two_mode)) g
    LEFT JOIN (SELECT com_bib, com_cit, PY, count(*) AS c FROM two_mode GROUP BY 1, 2, 3) k USING (com_bib, com_cit, PY)))"""
VIEWS["p6"] = """SELECT *, weight_adj / max(weight_adj) OVER () AS weight FROM (SELECT com1, com2, P, ws AS weight_sum, c AS weight_count,
    CAST(c AS DOUBLE) / (sum(c) OVER (PARTITION BY com1, P) + sum(c) OVER (PARTITION BY com2, P) - c) AS weight_adj FROM
    (SELECT com_bib AS com1, com_cit AS com2, P, sum(weight) AS ws, CAST(sum(weight_count) AS BIGINT) AS c FROM p5 GROUP BY 1, 2, 3))"""


def bib_ep(c):
    return tm.edges_with_periods(c.bib_edges, c.members.withColumnRenamed("XX", "id"), BOUNDS)


def cit_ep(c):
    return tm.edges_with_periods(c.cit_edges, c.ref_members.withColumnRenamed("SID", "id"), CITED_BOUNDS)


def bib_panel(c):
    return se.community_period_panel(c.members, BOUNDS)


def cit_panel(c):
    return se.community_period_panel(c.ref_members, CITED_BOUNDS, CIT_SUMS)


def p2(c):
    return tm.period_coupling_network(bib_ep(c), bib_panel(c))


def p4(c):
    return tm.period_cocitation_network(cit_ep(c))


def p5(c):
    rows = two_mode(c).join(c.pubs_dense.select(F.col("XX").alias("from"), "PY"), "from")
    return tm.two_mode_year(rows, bounds=BOUNDS)


def p6(c):
    return tm.two_mode_period(p5(c))


@query("edges_with_periods", "SELECT src, dst, weight, com1, com2, PY1, PY2, P1, P2 FROM bib_ep")
def _(c):
    return bib_ep(c)


NET = "SELECT com1, com2, P, weight_sum, round(weight_adj, 6) AS weight_adj, round(weight, 6) AS weight FROM "


@query("period_coupling_network", NET + "p2")
def _(c):
    return r6(p2(c), "weight_adj", "weight")


@query("overall_coupling_network", """SELECT com1, com2, round(w, 6) AS weight_adj, round(w / max(w) OVER (), 6) AS weight FROM
    (SELECT com1, com2, sum(weight_adj) AS w FROM p2 GROUP BY 1, 2)""")
def _(c):
    return r6(tm.overall_coupling_network(p2(c)), "weight_adj", "weight")


@query("overall_cocitation_network", """SELECT com1, com2, round(w, 6) AS weight_adj, round(w / max(w) OVER (), 6) AS weight FROM
    (SELECT com1, com2, sum(weight_adj) AS w FROM p4 GROUP BY 1, 2)""")
def _(c):
    return r6(tm.overall_cocitation_network(p4(c)), "weight_adj", "weight")


@query("overall_two_mode_network", "SELECT com1, com2, round(max(weight), 6) AS weight FROM p6 GROUP BY 1, 2")
def _(c):
    return r6(tm.overall_two_mode_network(p6(c)), "weight")


@query("period_cocitation_network", NET + "p4")
def _(c):
    return r6(p4(c), "weight_adj", "weight")


@query("two_mode_year", "SELECT com_bib, com_cit, PY, weight_count, round(weight, 6) AS weight, P FROM p5")
def _(c):
    return r6(p5(c), "weight")


@query("two_mode_period", "SELECT com1, com2, P, weight_count, round(weight_sum, 6) AS weight_sum, round(weight_adj, 6) AS weight_adj, round(weight, 6) AS weight FROM p6")
def _(c):
    return r6(p6(c), "weight_sum", "weight_adj", "weight")


VIEWS["docs_p"] = f"SELECT document, com, {period_sql('PY', TOPIC_BOUNDS)} AS P FROM doc_nodes"


def _docs_p(c):
    return doc_nodes(c).withColumn("P", period_of("PY", TOPIC_BOUNDS))


@query("topic_two_mode", """WITH r AS (SELECT com, topic, P, gamma FROM gamma JOIN docs_p USING (document)), n AS (SELECT com, P, count(*) AS n FROM docs_p GROUP BY 1, 2)
    SELECT g.com, g.topic, g.P, round(coalesce(w / n, 0), 6) AS weight FROM
    (SELECT * FROM (SELECT DISTINCT com FROM r), (SELECT DISTINCT topic FROM r), (SELECT DISTINCT P FROM r)) g
    LEFT JOIN (SELECT com, topic, P, sum(gamma) AS w FROM r GROUP BY 1, 2, 3) x ON g.com = x.com AND g.topic = x.topic AND g.P = x.P LEFT JOIN n ON g.com = n.com AND g.P = n.P""")
def _(c):
    docs = _docs_p(c)
    sizes = docs.groupBy("com", "P").agg(F.count(F.lit(1)).alias("n"))
    return r6(tm.topic_two_mode(c.gamma, docs, sizes), "weight")


@query("community_topic_edges", """SELECT com AS "from", topic AS "to", round(w, 6) AS weight_count,
    round(w / (sum(w) OVER (PARTITION BY com) + sum(w) OVER (PARTITION BY topic) - w), 6) AS weight FROM
    (SELECT com, topic, sum(gamma) AS w FROM gamma JOIN docs_p USING (document) GROUP BY 1, 2)""")
def _(c):
    return r6(tm.community_topic_edges(c.gamma, doc_nodes(c)), "weight_count", "weight")


@query("node_sizes_two_mode", """SELECT 'bib' AS kind, com, P, round(CAST(n AS DOUBLE) / max(n) OVER (), 6) AS n_rel FROM bib_panel
    UNION ALL SELECT 'cit', com, P, round(CAST(n AS DOUBLE) / max(n) OVER (), 6) FROM cit_panel""")
def _(c):
    return r6(tm.node_sizes_two_mode(bib_panel(c), cit_panel(c)), "n_rel")


@query("period_node_strength", """WITH s AS (SELECT id, P, sum(w) AS dgr FROM (SELECT com1 AS id, P, weight AS w FROM p2 UNION ALL SELECT com2, P, weight FROM p2) GROUP BY 1, 2)
    SELECT l.com AS id, t.P, round(coalesce(dgr, 0), 6) AS dgr, round(coalesce(dgr / max(dgr) OVER (PARTITION BY t.P), 0), 6) AS size
    FROM (SELECT DISTINCT com FROM labels) l CROSS JOIN (SELECT DISTINCT P FROM p2) t LEFT JOIN s ON s.id = l.com AND s.P = t.P""")
def _(c):
    return r6(tm.period_node_strength(p2(c), c.labels.select("com").distinct()), "dgr", "size")
