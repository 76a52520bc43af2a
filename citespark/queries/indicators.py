"""Bibliometric indicators."""

from pyspark.sql import functions as F

from citespark import functions as fn
from citespark.adapter import AS_OF_YEAR
from citespark.operators import cleaning as cl
from citespark.operators import indicators as ind
from citespark.operators.network import direct_citation_network
from citespark.queries import query
from citespark.queries.cleaning import RAU1, _trunc

Y = AS_OF_YEAR


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _direct(c):
    return direct_citation_network(c.cites, c.pubs)


@query("main_info", f"""WITH p AS (SELECT count(*) AS documents, count(DISTINCT SO) AS sources, min(PY) AS first_year, max(PY) AS last_year, avg(TC) AS mean_tc,
    avg(CAST(TC AS DOUBLE) / ({Y} - PY + 1)) AS mean_tc_year, avg({Y} - PY) AS mean_age FROM pubs),
    d AS (SELECT EID, count(*) AS n FROM pub_authors GROUP BY 1),
    a AS (SELECT count(DISTINCT AU) AS authors, count(*) AS appearances, count(DISTINCT AU) FILTER (WHERE n > 1) AS multi_authors FROM pub_authors x JOIN d ON x.EID = d.EID),
    m AS (SELECT count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n > 1) AS multi FROM d),
    r AS (SELECT count(DISTINCT SID) AS refs FROM cites), w AS (SELECT * FROM p, a, m, r)
    SELECT indicator, round(CAST(value AS DOUBLE), 6) AS value FROM (
    SELECT 'documents' AS indicator, CAST(documents AS DOUBLE) AS value FROM w UNION ALL SELECT 'sources', sources FROM w
    UNION ALL SELECT 'first_year', first_year FROM w UNION ALL SELECT 'last_year', last_year FROM w
    UNION ALL SELECT 'mean_tc', mean_tc FROM w UNION ALL SELECT 'mean_tc_year', mean_tc_year FROM w UNION ALL SELECT 'mean_age', mean_age FROM w
    UNION ALL SELECT 'references', refs FROM w UNION ALL SELECT 'authors', authors FROM w UNION ALL SELECT 'appearances', appearances FROM w
    UNION ALL SELECT 'single_authored_documents', single FROM w
    UNION ALL SELECT 'documents_per_author', CAST(documents AS DOUBLE) / authors FROM w UNION ALL SELECT 'authors_per_document', CAST(authors AS DOUBLE) / documents FROM w
    UNION ALL SELECT 'coauthors_per_document', CAST(appearances AS DOUBLE) / documents FROM w
    UNION ALL SELECT 'collaboration_index', CAST(multi_authors AS DOUBLE) / multi FROM w)""")
def _(c):
    return r6(ind.main_info(c.pubs, c.pub_authors, c.cites, Y), "value")


@query("annual_production", """WITH p AS (SELECT PY, count(*) AS n FROM pubs GROUP BY 1), e AS (SELECT min_by(n, PY) AS a, max_by(n, PY) AS b, max(PY) - min(PY) AS s FROM p)
    SELECT PY, n, round((pow(CAST(b AS DOUBLE) / a, 1.0 / s) - 1) * 100, 6) AS growth FROM p, e""")
def _(c):
    return r6(ind.annual_production(c.pubs), "growth")


FRAC = """f AS (SELECT a.AU, count(*) AS n, round(sum(1.0::DOUBLE / d.n), 9) AS n_frac FROM pub_authors a
    JOIN (SELECT EID, count(*) AS n FROM pub_authors GROUP BY 1) d ON a.EID = d.EID GROUP BY 1)"""


@query("top_authors", f"WITH {FRAC} SELECT AU, n, round(n_frac, 6) AS n_frac FROM f ORDER BY f.n_frac DESC, AU LIMIT 10")
def _(c):
    return r6(ind.top_authors(c.pub_authors), "n_frac")


@query("top_cited_documents", f"SELECT XX, PY, TC, round(CAST(TC AS DOUBLE) / ({Y} - PY + 1), 6) AS TC_year FROM pubs ORDER BY TC DESC, XX LIMIT 10")
def _(c):
    return r6(ind.top_cited_documents(c.pubs, Y).select("XX", "PY", "TC", "TC_year"), "TC_year")


FIRST_CN = "k AS (SELECT EID, min_by(CN, pos) AS CN, count(DISTINCT CN) AS n_cn FROM pub_countries GROUP BY 1)"


@query("country_collaboration", f"""WITH {FIRST_CN} SELECT CN, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM k), 6) AS Freq,
    count(*) FILTER (WHERE n_cn = 1) AS SCP, count(*) FILTER (WHERE n_cn > 1) AS MCP,
    round(CAST(count(*) FILTER (WHERE n_cn > 1) AS DOUBLE) / count(*), 6) AS MCP_ratio FROM k GROUP BY 1""")
def _(c):
    return r6(ind.country_collaboration(c.pub_countries), "Freq", "MCP_ratio")


@query("country_citations", f"WITH {FIRST_CN} SELECT CN, CAST(sum(TC) AS BIGINT) AS TC, round(avg(TC), 6) AS TC_mean FROM k JOIN pubs ON EID = XX GROUP BY 1")
def _(c):
    return r6(ind.country_citations(c.pub_countries, c.pubs), "TC_mean")


@query("top_sources", "SELECT SO, count(*) AS n FROM pubs GROUP BY 1 ORDER BY n DESC, SO LIMIT 3")
def _(c):
    return ind.top_values(c.pubs, "SO", 3)


@query("top_keywords", "SELECT DE, count(*) AS n FROM pub_keywords GROUP BY 1 ORDER BY n DESC, DE LIMIT 10")
def _(c):
    return ind.top_values(c.pub_keywords, "DE", 10)


def _frac_sql(col):
    return f"""SELECT {col}, round(sum(1.0::DOUBLE / d.n), 6) AS n_frac FROM pub_institutions x
        JOIN (SELECT EID, count(*) AS n FROM pub_institutions GROUP BY 1) d ON x.EID = d.EID GROUP BY 1 ORDER BY round(sum(1.0::DOUBLE / d.n), 9) DESC, {col} LIMIT 10"""


@query("top_institutions", _frac_sql("C1"))
def _(c):
    return r6(ind.top_fractional(c.pub_institutions, "C1"), "n_frac")


@query("top_countries", _frac_sql("C1_CN"))
def _(c):
    return r6(ind.top_fractional(c.pub_institutions, "C1_CN"), "n_frac")


@query("citations_per_year", f"SELECT PY, round(avg(TC), 6) AS TC_mean, round(avg(TC) / ({Y} - PY + 1), 6) AS TC_mean_year FROM pubs GROUP BY 1")
def _(c):
    return r6(ind.citations_per_year(c.pubs, Y), "TC_mean", "TC_mean_year")


@query("cited_references", "SELECT SID, count(*) AS n FROM cites GROUP BY 1 ORDER BY n DESC, SID LIMIT 20")
def _(c):
    return ind.cited_references(c.cites)


@query("local_citations", "SELECT XX, PY, TC AS GCS, LCS FROM pubs JOIN (SELECT dst, count(*) AS LCS FROM direct GROUP BY 1) ON XX = dst")
def _(c):
    return ind.local_citations(_direct(c), c.pubs)


@query("local_citations_by_author", """SELECT AU, CAST(sum(LCS) AS BIGINT) AS LCS FROM pub_authors JOIN (SELECT dst, count(*) AS LCS FROM direct GROUP BY 1) ON EID = dst GROUP BY 1""")
def _(c):
    return ind.local_citations_by_author(ind.local_citations(_direct(c), c.pubs), c.pub_authors)


@query("historiograph_table", """SELECT XX, PY, TC AS GCS, LCS FROM pubs JOIN (SELECT id, CAST(sum(x) AS BIGINT) AS LCS FROM
    (SELECT dst AS id, 1 AS x FROM direct UNION ALL SELECT src, 0 FROM direct) GROUP BY 1) ON XX = id""")
def _(c):
    return ind.historiograph_table(_direct(c), c.pubs)


@query("three_field_links", """WITH so AS (SELECT XX AS EID, SO FROM pubs),
    a AS (SELECT AU FROM pub_authors GROUP BY 1 ORDER BY count(*) DESC, AU LIMIT 20), k AS (SELECT DE FROM pub_keywords GROUP BY 1 ORDER BY count(*) DESC, DE LIMIT 20),
    s AS (SELECT SO FROM so GROUP BY 1 ORDER BY count(*) DESC, SO LIMIT 20)
    SELECT 'AU-DE' AS fields, AU AS source, DE AS target, count(*) AS n FROM pub_authors x JOIN pub_keywords y ON x.EID = y.EID
    WHERE AU IN (SELECT AU FROM a) AND DE IN (SELECT DE FROM k) GROUP BY 2, 3
    UNION ALL SELECT 'DE-SO', DE, SO, count(*) FROM pub_keywords x JOIN so y ON x.EID = y.EID WHERE DE IN (SELECT DE FROM k) AND SO IN (SELECT SO FROM s) GROUP BY 2, 3""")
def _(c):
    so = c.pubs.select(F.col("XX").alias("EID"), "SO")
    return ind.three_field_links(c.pub_authors, c.pub_keywords, so, ["AU", "DE", "SO"])


@query("author_production_over_time", f"""WITH t AS (SELECT AU FROM pub_authors GROUP BY 1 ORDER BY count(*) DESC, AU LIMIT 10)
    SELECT AU, PY, count(*) AS n, CAST(sum(TC) AS BIGINT) AS TC, round(sum(CAST(TC AS DOUBLE) / ({Y} - PY + 1)), 6) AS TC_year
    FROM pub_authors JOIN pubs ON EID = XX WHERE AU IN (SELECT AU FROM t) GROUP BY 1, 2""")
def _(c):
    return r6(ind.author_production_over_time(c.pub_authors, c.pubs, Y), "TC_year")


@query("reference_year_spectroscopy", """WITH y AS (SELECT PY, count(*) AS n FROM cites JOIN refs ON cites.SID = refs.SID GROUP BY 1),
    g AS (SELECT unnest(range(min(PY), max(PY) + 1)) AS PY FROM y), f AS (SELECT g.PY, coalesce(n, 0) AS n FROM g LEFT JOIN y ON g.PY = y.PY)
    SELECT PY, n, n - quantile_cont(n, 0.5) OVER (ORDER BY PY ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS deviation FROM f""")
def _(c):
    return ind.reference_year_spectroscopy(c.cites.join(c.refs, "SID"))


@query("community_size_density", "SELECT com, count(*) AS n, round(sum(dgr_int) / (count(*) * (count(*) - 1)) * 100, 3) AS density_int FROM node_deg GROUP BY 1")
def _(c):
    return ind.community_size_density(c.members)


@query("most_central", "SELECT XX, com, dgr_int FROM (SELECT *, rank() OVER (PARTITION BY com ORDER BY dgr_int DESC) AS r FROM members) WHERE r <= 10")
def _(c):
    return ind.most_central(c.members).select("XX", "com", "dgr_int")


@query("central_and_cited", """SELECT XX, com, round(s, 6) AS dgr_select FROM (SELECT *, rank() OVER (PARTITION BY com ORDER BY s DESC) AS r FROM
    (SELECT XX, com, dgr_int / max(dgr_int) OVER (PARTITION BY com) * (CAST(TC AS DOUBLE) / max(TC) OVER (PARTITION BY com)) AS s FROM members)) WHERE r <= 10""")
def _(c):
    return r6(ind.central_and_cited(c.members).select("XX", "com", "dgr_select"), "dgr_select")


def _str_list(src, col, out, n=10, width=None):
    text = _trunc(col, width) if width else col
    return f"""SELECT com, rn, {text} AS {col}, round({out}, 0) AS {out} FROM (SELECT com, {col}, {out}, CAST(row_number() OVER (PARTITION BY com ORDER BY {out} DESC, {col}) AS INTEGER) AS rn
        FROM (SELECT com, {col}, round(sum(dgr_int), 9) AS {out} FROM {src} GROUP BY 1, 2)) WHERE rn <= {n}"""


def _general_sql(where="TRUE", n=10):
    j = "(SELECT x.*, m.com, m.dgr_int FROM {} x JOIN mm m ON x.EID = m.XX)"
    return f"""WITH mm AS (SELECT * FROM members WHERE {where}), {RAU1},
    lab AS (SELECT c.EID, rau.AU1 || ' (' || CAST(r.PY AS VARCHAR) || ') ' || r.SO AS CR FROM cites_dense c JOIN refs r ON c.SID = r.SID JOIN rau ON r.SID = rau.SID),
    a AS ({_str_list(j.format('authors_dense'), 'AU', 'AU_dgr', n)}), s AS ({_str_list('mm', 'SO', 'SO_dgr', n, 45)}),
    i AS ({_str_list(j.format('institutions_dense'), 'C1', 'C1_dgr', n, 45)}), k AS ({_str_list(j.format('keywords_dense'), 'DE', 'DE_dgr', n)}),
    cr AS (SELECT com, rn, CR, CR_n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY com ORDER BY CR_n DESC, CR) AS INTEGER) AS rn FROM
      (SELECT m.com, CR, count(*) AS CR_n FROM lab JOIN mm m ON lab.EID = m.XX GROUP BY 1, 2)) WHERE rn <= {n})
    SELECT * FROM a FULL JOIN s USING (com, rn) FULL JOIN i USING (com, rn) FULL JOIN k USING (com, rn) FULL JOIN cr USING (com, rn)"""


def _ref_labels(c):
    r = c.refs.join(cl.first_authors(c.ref_authors, "SID"), "SID")
    return c.cites_dense.join(r.select("SID", fn.short_reference("AU1", "PY", "SO", 45).alias("CR")), "SID").select("EID", "CR")


@query("pub_summary_general", _general_sql())
def _(c):
    return ind.pub_summary_general(c.members, c.authors_dense, c.institutions_dense, c.keywords_dense, _ref_labels(c))


@query("gen_summary", _general_sql("com IN (2, 3)", 5))
def _(c):
    tables = {"pubs": c.members, "authors": c.authors_dense, "institutions": c.institutions_dense,
              "keywords": c.keywords_dense, "references": _ref_labels(c)}
    return ind.gen_summary(tables, "PUB", "general", 5, [2, 3])


@query("pub_summary_top", """SELECT com, rn, XX, PY, TI, SO, dgr_int FROM (SELECT *, CAST(row_number() OVER (PARTITION BY com ORDER BY dgr_int DESC, XX) AS INTEGER) AS rn FROM members) WHERE rn <= 10""")
def _(c):
    return ind.pub_summary_top(c.members).select("com", "rn", "XX", "PY", "TI", "SO", "dgr_int")


def _place(src, col, val, out, width=None):
    text = _trunc(col, width) if width else col
    return f"SELECT CAST(row_number() OVER (ORDER BY {val} DESC, {col}) AS INTEGER) AS rn, {text} AS {col}, round({val}, 0) AS {out} FROM {src} ORDER BY {val} DESC, {col} LIMIT 10"


def _frac9(col):
    return f"""(SELECT {col}, round(sum(1.0::DOUBLE / d.n), 9) AS v FROM pub_institutions x
        JOIN (SELECT EID, count(*) AS n FROM pub_institutions GROUP BY 1) d ON x.EID = d.EID GROUP BY 1)"""


@query("pub_summary_count", f"""WITH {FRAC}, a AS ({_place('f', 'AU', 'n_frac', 'AU_frac')}),
    s AS ({_place('(SELECT SO, count(*) AS v FROM pubs GROUP BY 1)', 'SO', 'v', 'SO_n', 45)}), i AS ({_place(_frac9('C1'), 'C1', 'v', 'C1_frac')}),
    cn AS ({_place(_frac9('C1_CN'), 'C1_CN', 'v', 'C1_CN_frac')}), k AS ({_place('(SELECT DE, count(*) AS v FROM pub_keywords GROUP BY 1)', 'DE', 'v', 'DE_n')})
    SELECT rn, AU, AU_frac, SO, CAST(SO_n AS BIGINT) AS SO_n, C1, C1_frac, C1_CN, C1_CN_frac, DE, CAST(DE_n AS BIGINT) AS DE_n
    FROM a FULL JOIN s USING (rn) FULL JOIN i USING (rn) FULL JOIN cn USING (rn) FULL JOIN k USING (rn)""")
def _(c):
    return ind.pub_summary_count(c.pubs, c.pub_authors, c.pub_institutions, c.pub_institutions, c.pub_keywords)


SR25 = f"sr AS (SELECT r.*, AU1 || ' (' || CAST(PY AS VARCHAR) || ') ' || {_trunc('SO', 25)} AS SR FROM {{}} r JOIN rau ON r.SID = rau.SID)"


def _with_sr(c, refs):
    return refs.join(cl.first_authors(c.ref_authors, "SID"), "SID").withColumn("SR", fn.short_reference("AU1", "PY", "SO", 25))


@query("ref_summary_count", f"""WITH {RAU1}, {SR25.format('refs')},
    a AS (SELECT AU, round(sum(CAST(TC AS DOUBLE) / N_AU), 9) AS f, round(sum(1.0::DOUBLE / N_AU), 9) AS g, avg(TC) AS h FROM ref_authors x JOIN refs r ON x.SID = r.SID JOIN rau ON rau.SID = x.SID GROUP BY 1),
    a1 AS (SELECT CAST(row_number() OVER (ORDER BY f DESC, AU) AS INTEGER) AS rn, AU, round(f, 0) AS AU_TC_frac, round(g, 0) AS AU_n_frac, round(h, 0) AS AU_TC_n FROM a),
    s AS (SELECT SO, sum(TC) AS f, count(*) AS n, avg(TC) AS h FROM refs GROUP BY 1),
    s1 AS (SELECT CAST(row_number() OVER (ORDER BY f DESC, SO) AS INTEGER) AS rn, SO, CAST(f AS BIGINT) AS SO_TC, n AS SO_n, round(h, 0) AS SO_TC_n FROM s),
    r1 AS (SELECT CAST(row_number() OVER (ORDER BY TC DESC, SID) AS INTEGER) AS rn, SR, TC AS SR_TC FROM sr)
    SELECT a1.*, s1.* EXCLUDE (rn), r1.* EXCLUDE (rn) FROM a1 JOIN s1 ON a1.rn = s1.rn JOIN r1 ON a1.rn = r1.rn WHERE a1.rn <= 10""")
def _(c):
    return ind.ref_summary_count(_with_sr(c, c.refs), c.ref_authors)


@query("ref_summary_general", f"""WITH {RAU1}, {SR25.format('ref_members')},
    ra AS (SELECT x.AU, m.com, m.dgr_int FROM ref_authors x JOIN ref_members m ON x.SID = m.SID),
    a AS ({_str_list('ra', 'AU', 'AU_dgr')}), s AS ({_str_list('ref_members', 'SO', 'SO_dgr', 10, 45)}),
    q AS (SELECT com, rn, SR, dgr_int AS SR_dgr FROM (SELECT *, CAST(row_number() OVER (PARTITION BY com ORDER BY dgr_int DESC, SID) AS INTEGER) AS rn FROM sr) WHERE rn <= 10)
    SELECT * FROM a FULL JOIN s USING (com, rn) FULL JOIN q USING (com, rn)""")
def _(c):
    return ind.ref_summary_general(_with_sr(c, c.ref_members), c.ref_authors)


@query("zoom_community", "SELECT XX, com2 AS com, r_name AS com_name, dgr_int FROM members JOIN region ON com2 = r_regionkey WHERE com = 3")
def _(c):
    names = c.table("region").select(F.col("r_regionkey").cast("long").alias("com"), F.col("r_name").alias("com_name"))
    return ind.zoom_community(c.members, 3, names).select("XX", "com", "com_name", "dgr_int")
