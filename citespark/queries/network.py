"""Graph operators."""

from pyspark.sql import functions as F

from citespark.operators import network as nw
from citespark.queries import query


@query("incidence", "SELECT DISTINCT l_orderkey AS EID, l_partkey AS SID FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL")
def _(c):
    return nw.incidence(c.table("lineitem"), "l_orderkey", "l_partkey").toDF("EID", "SID")


@query("bib_coupling", """SELECT a.EID AS src, b.EID AS dst, count(*) AS weight FROM cites_dense a JOIN cites_dense b
    ON a.SID = b.SID AND a.EID < b.EID GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(c):
    return nw.bib_coupling(c.cites_dense, min_weight=2)


@query("co_citation", """SELECT a.SID AS src, b.SID AS dst, count(*) AS weight FROM cites a JOIN cites b
    ON a.EID = b.EID AND a.SID < b.SID GROUP BY 1, 2""")
def _(c):
    return nw.co_citation(c.cites)


@query("coupling_jaccard", """SELECT e.src, e.dst, e.weight AS weight_count,
    round(CAST(e.weight AS DOUBLE) / (a.NR + b.NR - e.weight), 3) AS weight
    FROM bib_edges e JOIN pubs_dense a ON e.src = a.XX JOIN pubs_dense b ON e.dst = b.XX""")
def _(c):
    return nw.coupling_jaccard(c.bib_edges, c.pubs_dense)


CIT_DGR = """d AS (SELECT id, CAST(sum(weight) AS DOUBLE) AS dgr FROM (SELECT src AS id, weight FROM cit_edges
    UNION ALL SELECT dst, weight FROM cit_edges) GROUP BY 1)"""
BIB_DGR = CIT_DGR.replace("cit_edges", "bib_edges")


@query("degree_jaccard", f"""WITH {CIT_DGR} SELECT e.src, e.dst, e.weight, round(e.weight / (a.dgr + b.dgr - e.weight), 6) AS weight_jac
    FROM cit_edges e JOIN d a ON e.src = a.id JOIN d b ON e.dst = b.id""")
def _(c):
    return nw.degree_jaccard(c.cit_edges).withColumn("weight_jac", F.round("weight_jac", 6))


@query("degree_jaccard_nodes", f"""WITH {CIT_DGR}, j AS (SELECT e.src, e.dst, e.weight / (a.dgr + b.dgr - e.weight) AS w
    FROM cit_edges e JOIN d a ON e.src = a.id JOIN d b ON e.dst = b.id)
    SELECT id, round(sum(w), 6) AS dgr_jac FROM (SELECT src AS id, w FROM j UNION ALL SELECT dst, w FROM j) GROUP BY 1""")
def _(c):
    j = nw.degree_jaccard(c.cit_edges)
    return nw.weighted_degree(j, weight="weight_jac", name="dgr_jac").withColumn("dgr_jac", F.round("dgr_jac", 6))


@query("pairwise_jaccard", """WITH g AS (SELECT p.PY, l.com, r.com AS com_cit, count(*) AS w FROM cites_dense x
    JOIN pubs_dense p ON x.EID = p.XX JOIN labels l ON x.EID = l.id JOIN labels_cit r ON x.SID = r.id GROUP BY 1, 2, 3)
    SELECT PY, com, com_cit, w, round(CAST(w AS DOUBLE) / (sum(w) OVER (PARTITION BY PY, com) + sum(w) OVER (PARTITION BY PY, com_cit) - w), 6) AS weight_jac
    FROM g""")
def _(c):
    x = nw.two_mode_edges(c.cites_dense, c.labels, c.labels_cit)
    x = x.join(c.pubs_dense.select(F.col("XX").alias("from"), "PY"), "from")
    g = x.groupBy("PY", F.col("com_bib").alias("com"), "com_cit").agg(F.count(F.lit(1)).alias("w"))
    return nw.pairwise_jaccard(g, "com", "com_cit", "w", by=["PY"]).withColumn("weight_jac", F.round("weight_jac", 6))


@query("cocit_minmax", """WITH r AS (SELECT min(weight) AS lo, max(weight) AS hi FROM cit_edges)
    SELECT * FROM (SELECT src, dst, weight AS weight_count, round(CAST(weight - lo AS DOUBLE) / (hi - lo), 3) AS weight
    FROM cit_edges, r) WHERE weight > 0""")
def _(c):
    return nw.cocit_minmax(c.cit_edges)


@query("weighted_degree", f"WITH {BIB_DGR} SELECT p.XX AS id, coalesce(d.dgr, 0) AS dgr FROM pubs_dense p LEFT JOIN d ON p.XX = d.id")
def _(c):
    return nw.weighted_degree(c.bib_edges, c.pubs_dense.select(F.col("XX").alias("id")))


@query("simplify_graph", """SELECT least(l_orderkey, l_partkey) AS src, greatest(l_orderkey, l_partkey) AS dst,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY 1, 2""")
def _(c):
    raw = c.table("lineitem").select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"))
    return nw.simplify_graph(raw)


@query("edge_weight_cut", "SELECT src, dst, weight FROM bib_edges WHERE weight >= 4")
def _(c):
    return nw.edge_weight_cut(c.bib_edges, 4)


@query("edge_quantile_cut", """SELECT src, dst, weight FROM bib_edges
    WHERE weight > (SELECT quantile_cont(weight, 0.75) FROM bib_edges)""")
def _(c):
    return nw.edge_quantile_cut(c.bib_edges, 0.75)


@query("drop_isolates", """SELECT XX AS id, PY FROM pubs_dense WHERE XX IN (SELECT src FROM cit_edges UNION SELECT dst FROM cit_edges)""")
def _(c):
    return nw.drop_isolates(c.pubs_dense.select(F.col("XX").alias("id"), "PY"), c.cit_edges)


@query("node_percent_rank_cut", f"""WITH {BIB_DGR}, k AS (SELECT id FROM (SELECT id, percent_rank() OVER (ORDER BY dgr) AS pr FROM d) WHERE pr >= 0.5)
    SELECT src, dst, weight FROM bib_edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def _(c):
    return nw.node_percent_rank_cut(nw.weighted_degree(c.bib_edges), c.bib_edges, 0.5)[1].select("src", "dst", "weight")


@query("node_degree_cut", f"""WITH {CIT_DGR} SELECT id, dgr FROM d WHERE dgr > (SELECT quantile_cont(dgr, 0.10) FROM d)""")
def _(c):
    return nw.node_degree_cut(nw.weighted_degree(c.cit_edges), c.cit_edges, p=0.10)[0]


@query("node_degree_cut_edges", f"""WITH {CIT_DGR}, k AS (SELECT id FROM d WHERE dgr >= 50)
    SELECT src, dst, weight FROM cit_edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def _(c):
    return nw.node_degree_cut(nw.weighted_degree(c.cit_edges), c.cit_edges, k=50)[1].select("src", "dst", "weight")


@query("internal_degree", "SELECT id, com, com2, dgr, dgr_int, dgr_int2, dgr - dgr_int AS dgr_ext FROM node_deg")
def _(c):
    return nw.external_degree(nw.internal_degree(c.labels, c.bib_edges))


SIZED = """b AS (SELECT *, 'c' || CAST(NR % 9 AS VARCHAR) AS com, TC % 4 AS com2 FROM pubs_dense),
    n1 AS (SELECT com, count(*) AS n FROM b GROUP BY 1), n2 AS (SELECT com, com2, count(*) AS n FROM b GROUP BY 1, 2),
    k AS (SELECT b.XX AS id, b.com, CASE WHEN n2.n >= 40 THEN b.com2 ELSE -1 END AS com2 FROM b JOIN n1 ON b.com = n1.com
    JOIN n2 ON b.com = n2.com AND b.com2 = n2.com2 WHERE n1.n >= 160)"""


def _sized(c):
    return c.pubs_dense.select(
        F.col("XX").alias("id"), F.concat(F.lit("c"), (F.col("NR") % 9).cast("string")).alias("com"), (F.col("TC") % 4).alias("com2"))


@query("community_size_filter", f"""WITH {SIZED}, i AS (SELECT * FROM bib_edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)),
    d AS (SELECT id, sum(weight) AS dgr FROM (SELECT src AS id, weight FROM i UNION ALL SELECT dst, weight FROM i) GROUP BY 1)
    SELECT k.id, k.com, k.com2, CAST(coalesce(d.dgr, 0) AS DOUBLE) AS dgr FROM k LEFT JOIN d ON k.id = d.id""")
def _(c):
    nodes, _ = nw.community_size_filter(_sized(c), c.bib_edges, 160, 40)
    return nodes.withColumn("com2", F.coalesce("com2", F.lit(-1).cast("long")))


COM_NET = """n AS (SELECT com, count(*) AS N FROM labels GROUP BY 1),
    a AS (SELECT least(i.com, j.com) AS src, greatest(i.com, j.com) AS dst, CAST(sum(weight) AS BIGINT) AS weight
    FROM bib_edges e JOIN labels i ON e.src = i.id JOIN labels j ON e.dst = j.id GROUP BY 1, 2)"""


@query("community_network", f"""WITH {COM_NET} SELECT a.src, a.dst, a.weight, i.N AS N_src, j.N AS N_dst
    FROM a JOIN n i ON a.src = i.com JOIN n j ON a.dst = j.com""")
def _(c):
    nodes, edges = nw.community_network(c.labels, c.bib_edges)
    return nw.attach_to_ends(edges, nodes, ["N"], key="com", suffixes=("_src", "_dst"))


COM_DENSE = f"""{COM_NET}, w AS (SELECT a.src, a.dst, a.weight AS weight_count, round(CAST(a.weight AS DOUBLE) / (i.N * j.N) * 100, 4) AS weight
    FROM a JOIN n i ON a.src = i.com JOIN n j ON a.dst = j.com)"""


@query("community_density_weight", f"WITH {COM_DENSE} SELECT * FROM w")
def _(c):
    return nw.community_density_weight(*nw.community_network(c.labels, c.bib_edges))[1]


@query("community_density_nodes", f"""WITH {COM_DENSE} SELECT com, N, round(sum(weight), 4) AS dgr FROM n JOIN
    (SELECT src AS id, weight FROM w UNION ALL SELECT dst, weight FROM w) ON com = id GROUP BY 1, 2""")
def _(c):
    nodes = nw.community_density_weight(*nw.community_network(c.labels, c.bib_edges))[0]
    return nodes.withColumn("dgr", F.round("dgr", 4))


@query("community_network_view", f"""WITH {COM_NET}, v AS (SELECT * FROM a WHERE src <> dst AND weight > 0)
    SELECT src, dst, weight FROM v WHERE weight >= (SELECT quantile_cont(weight, 0.25) FROM v)""")
def _(c):
    return nw.community_network_view(nw.community_network(c.labels, c.bib_edges)[1])


@query("two_mode_edges", """SELECT x.EID AS "from", x.SID AS "to", l.com AS com_bib, r.com AS com_cit FROM cites_dense x
    JOIN labels l ON x.EID = l.id JOIN labels_cit r ON x.SID = r.id""")
def _(c):
    return nw.two_mode_edges(c.cites_dense, c.labels, c.labels_cit)


@query("ego_top_subgraph", """WITH t AS (SELECT id, com2 FROM (SELECT id, com2, row_number() OVER (PARTITION BY com2 ORDER BY dgr_int2 DESC, id) AS rn
    FROM node_deg) WHERE rn <= 100),
    i AS (SELECT a.com2, e.src, e.dst, e.weight FROM bib_edges e JOIN t a ON e.src = a.id JOIN t b ON e.dst = b.id WHERE a.com2 = b.com2),
    q AS (SELECT com2, quantile_cont(weight, 0.75) AS q FROM i GROUP BY 1)
    SELECT i.com2, src, dst, weight FROM i JOIN q ON i.com2 = q.com2 WHERE weight >= q""")
def _(c):
    return nw.ego_top_subgraph(nw.internal_degree(c.labels, c.bib_edges), c.bib_edges)


@query("graph_join_attributes", """SELECT e.src, e.dst, e.weight, a.PY AS PY_i, a.SO AS SO_i, b.PY AS PY_j, b.SO AS SO_j
    FROM bib_edges e JOIN pubs_dense a ON e.src = a.XX JOIN pubs_dense b ON e.dst = b.XX""")
def _(c):
    nodes = nw.join_node_attributes(c.labels, c.pubs_dense)
    return nw.attach_to_ends(c.bib_edges, nodes, ["PY", "SO"])


@query("modularity", """WITH p AS (SELECT com, sum(weight) AS deg, sum(CASE WHEN com = com_o THEN weight ELSE 0 END) / 2.0 AS w_in FROM bib_ends GROUP BY 1),
    t AS (SELECT sum(deg) / 2.0 AS m FROM p)
    SELECT round(sum(w_in / m - (deg / (2 * m)) * (deg / (2 * m))), 6) AS modularity, max(CAST(m AS DOUBLE)) AS m FROM p, t""")
def _(c):
    return nw.modularity(c.labels, c.bib_edges).withColumn("modularity", F.round("modularity", 6))


@query("direct_citation_network", "SELECT DISTINCT src, dst FROM direct")
def _(c):
    return nw.direct_citation_network(c.cites, c.pubs).select("src", "dst")


@query("historiograph_top", """WITH s AS (SELECT dst AS id, count(*) AS lcs FROM direct GROUP BY 1),
    k AS (SELECT id FROM (SELECT id, rank() OVER (ORDER BY lcs DESC) AS r FROM s) WHERE r <= 50)
    SELECT src, dst FROM direct WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def _(c):
    return nw.historiograph_top(nw.direct_citation_network(c.cites, c.pubs), 50)[1].select("src", "dst")


@query("historiograph_top_nodes", """SELECT id, lcs FROM (SELECT id, lcs, rank() OVER (ORDER BY lcs DESC) AS r FROM
    (SELECT dst AS id, count(*) AS lcs FROM direct GROUP BY 1)) WHERE r <= 50""")
def _(c):
    return nw.historiograph_top(nw.direct_citation_network(c.cites, c.pubs), 50)[0]


@query("association_strength", """WITH s AS (SELECT EID, count(*) AS s FROM cites_dense GROUP BY 1)
    SELECT e.src, e.dst, e.weight, round(CAST(e.weight AS DOUBLE) / (a.s * b.s), 9) AS assoc FROM bib_edges e
    JOIN s a ON e.src = a.EID JOIN s b ON e.dst = b.EID""")
def _(c):
    return nw.association_strength(c.bib_edges, c.cites_dense).withColumn("assoc", F.round("assoc", 9))


@query("merge_node_universe", f"""WITH {CIT_DGR} SELECT p.SID AS id, coalesce(d.dgr, 0) AS dgr,
    round(coalesce(d.dgr / (SELECT max(dgr) FROM d), 0), 6) AS size FROM refs p LEFT JOIN d ON p.SID = d.id""")
def _(c):
    names = c.refs.select(F.col("SID").alias("id"))
    return nw.merge_node_universe(names, nw.weighted_degree(c.cit_edges)).withColumn("size", F.round("size", 6))
