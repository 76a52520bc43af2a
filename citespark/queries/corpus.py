"""Corpus building and selection."""

from pyspark.sql import functions as F

from citespark.adapter import AS_OF_YEAR
from citespark.functions import tc_per_year
from citespark.operators import corpus as co
from citespark.queries import query

TCY = f"round(CAST(TC AS DOUBLE) / ({AS_OF_YEAR} - PY + 1), 2)"


def _pubs(c):
    return c.pubs.withColumn("TC_year", tc_per_year("TC", "PY", AS_OF_YEAR, 2))


@query("first_wins_dedupe", "SELECT XX, batch, PY, TC FROM (SELECT *, row_number() OVER (PARTITION BY XX ORDER BY batch) AS rn FROM batches) WHERE rn = 1")
def _(c):
    return co.first_wins_dedupe(c.batches).select("XX", "batch", "PY", "TC")


REPORT = """r AS (SELECT batch, count(*) AS loaded, count(*) FILTER (WHERE rn = 1) AS added FROM
    (SELECT batch, row_number() OVER (PARTITION BY XX ORDER BY batch) AS rn FROM batches) GROUP BY 1)"""


@query("ingest_report", f"WITH {REPORT} SELECT batch, loaded, added, CAST(sum(added) OVER (ORDER BY batch) AS BIGINT) AS total FROM r")
def _(c):
    return co.ingest_report(c.batches)


@query("corpus_saturation", f"WITH {REPORT} SELECT batch, added AS n, CAST(sum(added) OVER (ORDER BY batch) AS BIGINT) AS n_cum FROM r")
def _(c):
    return co.corpus_saturation(c.batches)


@query("unique_keys", """SELECT CASE WHEN rn = 1 THEN DT ELSE DT || '_' || CAST(rn - 1 AS VARCHAR) END AS DT, XX FROM
    (SELECT DT, XX, row_number() OVER (PARTITION BY DT ORDER BY XX) AS rn FROM pubs)""")
def _(c):
    return co.unique_keys(c.pubs.select("DT", "XX"), "DT", "XX")


@query("exclude_values", "SELECT XX, DT, SO FROM pubs WHERE DT <> '5-LOW' AND SO <> 'MACHINERY'")
def _(c):
    return co.exclude_values(c.pubs.select("XX", "DT", "SO"), [("DT", "5-LOW"), ("SO", "MACHINERY")])


@query("range_filter", f"SELECT XX, PY, TC, DT FROM pubs WHERE TC >= 100 AND {TCY} >= 5 AND PY BETWEEN 1996 AND 2000 AND DT IN ('1-URGENT', '2-HIGH')")
def _(c):
    return co.range_filter(_pubs(c), 100, 1996, 2000, 5, ["1-URGENT", "2-HIGH"]).select("XX", "PY", "TC", "DT")


@query("quality_filter", f"""SELECT p.XX, p.PY, p.TC, n.NR FROM pubs p JOIN (SELECT EID, count(*) AS NR FROM cites GROUP BY 1) n ON p.XX = n.EID
    WHERE (TC >= 400 OR {TCY} >= 12) AND PY BETWEEN 1996 AND 2000 AND NR BETWEEN 3 AND 6 AND DT NOT IN ('5-LOW')""")
def _(c):
    nr = c.cites.groupBy(F.col("EID").alias("XX")).agg(F.count(F.lit(1)).alias("NR"))
    d = co.quality_filter(_pubs(c).join(nr, "XX"), 400, 12, (1996, 2000), (3, 6), ["5-LOW"])
    return d.select("XX", "PY", "TC", "NR")


@query("quantile_or_filter", f"""WITH p AS (SELECT XX, TC, {TCY} AS TC_year FROM pubs)
    SELECT * FROM p WHERE TC >= (SELECT quantile_cont(TC, 0.5) FROM p) OR TC_year >= (SELECT quantile_cont(TC_year, 0.5) FROM p)""")
def _(c):
    return co.quantile_or_filter(_pubs(c).select("XX", "TC", "TC_year"))


@query("top_cited_export", f"""WITH p AS (SELECT XX, TC, {TCY} AS TC_year FROM pubs),
    r AS (SELECT *, (rank() OVER (ORDER BY TC) + (count(*) OVER (PARTITION BY TC) - 1) / 2.0::DOUBLE) / count(*) OVER () AS a,
    (rank() OVER (ORDER BY TC_year) + (count(*) OVER (PARTITION BY TC_year) - 1) / 2.0::DOUBLE) / count(*) OVER () AS b FROM p)
    SELECT XX, TC, TC_year, round(a, 2) AS percentile_TC, round(b, 2) AS percentile_TCyear FROM r ORDER BY TC DESC, XX LIMIT 100""")
def _(c):
    return co.top_cited_export(_pubs(c).select("XX", "TC", "TC_year"))


@query("top_cited_per_year_export", f"""WITH p AS (SELECT XX, TC, {TCY} AS TC_year FROM pubs)
    SELECT XX, TC, TC_year FROM p ORDER BY TC_year DESC, XX LIMIT 100""")
def _(c):
    return co.top_cited_export(_pubs(c).select("XX", "TC", "TC_year"), by="TC_year").select("XX", "TC", "TC_year")


SEEDS = """s AS (SELECT XX FROM (SELECT XX, PY, percent_rank() OVER (ORDER BY TC) AS p, percent_rank() OVER (PARTITION BY PY ORDER BY TC) AS q,
    row_number() OVER (PARTITION BY PY ORDER BY TC DESC, XX) AS rn FROM pubs) WHERE p >= 0.99 OR q >= 0.99 OR (PY IN (1999, 2000) AND rn <= 3))"""


@query("seed_selection", f"WITH {SEEDS} SELECT XX FROM s")
def _(c):
    return co.seed_selection(c.pubs, 0.01, (1999, 2000))


@query("expand_from_seeds", """WITH s AS (SELECT XX FROM (SELECT XX, percent_rank() OVER (ORDER BY TC) AS p FROM pubs_dense) WHERE p >= 0.99),
    h AS (SELECT a.EID AS seed, b.EID, count(*) AS shared FROM cites_dense a JOIN cites_dense b ON a.SID = b.SID AND a.EID <> b.EID
    WHERE a.EID IN (SELECT XX FROM s) GROUP BY 1, 2)
    SELECT * FROM (SELECT seed, EID, shared, CAST(row_number() OVER (PARTITION BY seed ORDER BY shared DESC, EID) AS INTEGER) AS rank FROM h) WHERE rank <= 50""")
def _(c):
    from citespark.functions import percent_ranks
    seeds = percent_ranks(c.pubs_dense, "TC", name="_p").where(F.col("_p") >= 0.99).select(F.col("XX").alias("seed"))
    return co.expand_from_seeds(seeds, c.cites_dense, 50)


@query("seed_list", f"""WITH {SEEDS} SELECT row_number() OVER (ORDER BY TC_year DESC, XX) AS no, XX, PY, TI, SO, TC, TC_year FROM
    (SELECT *, {TCY} AS TC_year FROM pubs WHERE XX IN (SELECT XX FROM s))""")
def _(c):
    seeds = c.pubs.join(co.seed_selection(c.pubs, 0.01, (1999, 2000)), "XX", "left_semi")
    return co.seed_list(seeds, AS_OF_YEAR)


@query("restrict_to_network", "SELECT XX, PY, TC FROM pubs_dense WHERE XX IN (SELECT src FROM bib_edges UNION SELECT dst FROM bib_edges)")
def _(c):
    from citespark.operators.network import weighted_degree
    return co.restrict_to_network(c.pubs_dense, weighted_degree(c.bib_edges)).select("XX", "PY", "TC")


@query("merge_network_labels", "SELECT p.XX, p.PY, p.TC, d.com, d.com2, d.dgr, d.dgr_int, d.dgr_int2 FROM pubs_dense p JOIN node_deg d ON p.XX = d.id")
def _(c):
    from citespark.operators.network import internal_degree
    d = internal_degree(c.labels, c.bib_edges)
    twice = d.unionByName(d)
    return co.merge_network_labels(c.pubs_dense.select("XX", "PY", "TC"), twice)


@query("label_lookup", """SELECT l.id, l.com, coalesce(r_name, 'none') AS com_name FROM labels l LEFT JOIN region ON l.com = r_regionkey""")
def _(c):
    names = c.table("region").select(F.col("r_regionkey").cast("long").alias("com"), F.col("r_name").alias("com_name"))
    return co.label_lookup(c.labels.select("id", "com"), names).withColumn("com_name", F.coalesce("com_name", F.lit("none")))
