"""Cleaning and shaping operators."""

from pyspark.sql import functions as F

from citespark import functions as fn
from citespark.adapter import AS_OF_YEAR
from citespark.operators import cleaning as cl
from citespark.queries import query

SQ = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"


@query("squish_strings", f"SELECT EID, md5({SQ.format('AB')}) AS h, CAST(length({SQ.format('AB')}) AS BIGINT) AS n FROM abstracts")
def _(c):
    d = cl.squish_strings(c.abstracts.select("EID", "AB"))
    return d.select("EID", F.md5("AB").alias("h"), F.length("AB").cast("long").alias("n"))


DIRTY = """SELECT p_partkey AS SID, '  ' || p_name || CASE p_size % 4 WHEN 0 THEN ';' WHEN 1 THEN ',;' WHEN 2 THEN '' ELSE ' ; ' END AS TI,
    CASE p_size % 6 WHEN 0 THEN 'NULL' WHEN 1 THEN '[No abstract available]' WHEN 2 THEN '' WHEN 3 THEN 'numeric()' ELSE p_type END AS AB FROM part"""


def _dirty(c):
    size = F.col("p_size")
    tail = F.when(size % 4 == 0, ";").when(size % 4 == 1, ",;").when(size % 4 == 2, "").otherwise(" ; ")
    ab = (F.when(size % 6 == 0, "NULL").when(size % 6 == 1, "[No abstract available]").when(size % 6 == 2, "")
          .when(size % 6 == 3, "numeric()").otherwise(F.col("p_type")))
    return c.table("part").select(F.col("p_partkey").alias("SID"), F.concat(F.lit("  "), "p_name", tail).alias("TI"), ab.alias("AB"))


@query("strip_trailing_sep", f"SELECT SID, regexp_replace(TI, '[,;]+$', '') AS TI, regexp_replace(AB, '[,;]+$', '') AS AB FROM ({DIRTY})")
def _(c):
    return cl.strip_trailing_seps(_dirty(c))


MISS = "CASE WHEN {0} IN ('', ' ', 'NA', 'NULL', 'list()', 'character()', 'numeric()', '[No abstract available]', '[No author name available]') THEN NULL ELSE {0} END"


@query("normalize_missing", f"SELECT SID, TI, {MISS.format('AB')} AS AB FROM ({DIRTY})")
def _(c):
    return cl.normalize_missing_strings(_dirty(c))


@query("drop_missing", f"SELECT * FROM (SELECT SID, TI, {MISS.format('AB')} AS AB FROM ({DIRTY})) WHERE AB IS NOT NULL")
def _(c):
    return cl.drop_missing(cl.normalize_missing_strings(_dirty(c)), ["AB"])


@query("tc_per_year", f"""SELECT XX, round(CAST(TC AS DOUBLE) / ({AS_OF_YEAR} - PY + 1), 2) AS TC_year,
    round(CAST(TC AS DOUBLE) / (1999 - least(PY, 1999) + 1), 6) AS TC_year_clip FROM pubs""")
def _(c):
    return c.pubs.select(
        "XX", fn.tc_per_year("TC", "PY", AS_OF_YEAR, 2).alias("TC_year"),
        F.round(fn.tc_per_year("TC", "PY", 1999, py_max=1999), 6).alias("TC_year_clip"))


@query("clean_author", r"""SELECT s_suppkey AS AU_ID, CASE WHEN s_suppkey % 10 = 0 THEN 'Dosi G'
    ELSE trim(regexp_replace(regexp_replace(s_name || '   J.A. jr.', '\s+', ' ', 'g'), '\..*', '')) END AS AU FROM supplier""")
def _(c):
    raw = F.when(F.col("s_suppkey") % 10 == 0, F.lit(" Dosi")).otherwise(F.concat("s_name", F.lit("   J.A. jr.")))
    return cl.clean_authors(c.table("supplier").select(F.col("s_suppkey").alias("AU_ID"), raw.alias("AU")))


@query("split_fields", """SELECT p_partkey AS EID, lower(p_type) || '|' || lower(p_name) || '|' || lower(p_brand) AS DE,
    CAST(3 AS BIGINT) AS DE_NR, CAST(2 AS BIGINT) AS AU_NR, p_name || ' & ' || p_brand AS AU1 FROM part""")
def _(c):
    p = c.table("part")
    d = cl.split_fields(p.select(
        F.col("p_partkey").alias("EID"), F.concat_ws("; ", "p_type", "p_name", "p_brand").alias("DE"),
        F.concat_ws(", ", "p_name", "p_brand").alias("AU")))
    return d.select("EID", F.array_join("DE", "|").alias("DE"), F.size("DE").cast("long").alias("DE_NR"), "AU_NR", "AU1")


AU1 = """au AS (SELECT EID, count(*) AS N_AU, CASE count(*) WHEN 1 THEN min_by(AU, pos) WHEN 2 THEN min_by(AU, pos) || ' & ' || max_by(AU, pos)
    ELSE min_by(AU, pos) || ' et al.' END AS AU1 FROM pub_authors GROUP BY 1)"""
RAU1 = AU1.replace("au AS", "rau AS").replace("EID", "SID").replace("pub_authors", "ref_authors")


@query("first_author_label", f"WITH {AU1} SELECT EID, AU1, N_AU FROM au")
def _(c):
    return cl.first_authors(c.pub_authors)


def _trunc(col, n):
    return f"CASE WHEN length({col}) > {n} THEN substr({col}, 1, {n - 3}) || '...' ELSE {col} END"


@query("short_reference", f"""WITH {RAU1} SELECT r.SID, AU1 || ' (' || CAST(PY AS VARCHAR) || ') ' || {_trunc("(TI || ' by ' || SO)", 25)} AS SR,
    AU1 || ', (' || CAST(PY AS VARCHAR) || ') ' || {_trunc('SO', 50)} AS SR_pub FROM refs r JOIN rau ON r.SID = rau.SID""")
def _(c):
    d = c.refs.join(cl.first_authors(c.ref_authors, "SID"), "SID")
    return d.select(
        "SID", fn.short_reference("AU1", "PY", F.concat("TI", F.lit(" by "), "SO"), 25).alias("SR"),
        fn.short_reference("AU1", "PY", "SO", 50, comma=True).alias("SR_pub"))


@query("truncate_text", f"SELECT XX, {_trunc('TI', 20)} AS TI20, {_trunc('TI', 45)} AS TI45 FROM pubs")
def _(c):
    return c.pubs.select("XX", fn.truncate_text("TI", 20).alias("TI20"), fn.truncate_text("TI", 45).alias("TI45"))


@query("select_columns", "SELECT l_orderkey AS EID, linenumber, quantity, discount FROM (SELECT l_orderkey, l_linenumber AS linenumber, l_quantity AS quantity, l_discount AS discount FROM lineitem)")
def _(c):
    d = cl.select_columns(c.table("lineitem"), drop=["l_partkey", "l_suppkey", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus"],
                          drop_prefix="l_ship", rename={"l_orderkey": "EID"}, strip_prefix="l_")
    return d


PRUNE = """r AS (SELECT c.* FROM cites c WHERE EID IN (SELECT XX FROM pubs WHERE PY >= 1997)),
    t AS (SELECT SID, count(*) AS CR_TC FROM r GROUP BY 1 HAVING count(*) >= 2),
    p AS (SELECT r.EID, r.SID, t.CR_TC FROM r JOIN t ON r.SID = t.SID),
    n AS (SELECT EID, count(*) AS NR FROM p GROUP BY 1 HAVING count(*) >= 2)"""


@query("min_citation_pruning", f"WITH {PRUNE} SELECT p.EID, p.SID, p.CR_TC, n.NR FROM p JOIN n ON p.EID = n.EID")
def _(c):
    return cl.min_citation_pruning(c.cites, c.pubs.where(F.col("PY") >= 1997))


@query("reference_table", f"""WITH {RAU1} SELECT r.SID, r.TC, rau.AU1, r.PY, r.SO, AU1 || ' (' || CAST(PY AS VARCHAR) || ') ' || {_trunc('SO', 25)} AS SR
    FROM refs r JOIN rau ON r.SID = rau.SID WHERE r.SID IN (SELECT SID FROM cites)""")
def _(c):
    rows = c.cites.join(c.refs, "SID").join(cl.first_authors(c.ref_authors, "SID"), "SID")
    return cl.reference_table(rows).select("SID", "TC", "AU1", "PY", "SO", "SR")


WORKS = """w AS (SELECT a.AU, r.SID, r.TC, n.N_AU FROM ref_authors a JOIN refs r ON a.SID = r.SID
    JOIN (SELECT SID, count(*) AS N_AU FROM ref_authors GROUP BY 1) n ON a.SID = n.SID)"""


@query("cited_author_table", f"""WITH {WORKS} SELECT AU, count(*) AS AU_N, round(sum(1.0::DOUBLE / N_AU), 6) AS AU_N_frac, CAST(sum(TC) AS BIGINT) AS AU_TC,
    round(sum(CAST(TC AS DOUBLE) / N_AU), 6) AS AU_TC_frac FROM w GROUP BY 1""")
def _(c):
    d = cl.cited_author_table(cl.cited_author_works(c.refs, c.ref_authors))
    return d.withColumns({k: F.round(k, 6) for k in ("AU_N_frac", "AU_TC_frac")})


@query("cited_author_works", f"""WITH {WORKS} SELECT AU, SID, N_AU, round(CAST(TC AS DOUBLE) / N_AU, 6) AS TC_frac FROM w""")
def _(c):
    return cl.cited_author_works(c.refs, c.ref_authors).select("AU", "SID", "N_AU", F.round("TC_frac", 6).alias("TC_frac"))


@query("assemble_publications", f"""WITH {AU1} SELECT p.XX, p.PY, p.TC, au.AU1, au.N_AU, n.NR, n.NR AS n_cr, f.n_c1,
    au.AU1 || ', (' || CAST(p.PY AS VARCHAR) || ') ' || p.SO AS SR
    FROM pubs p JOIN (SELECT EID, count(*) AS NR FROM cites GROUP BY 1) n ON p.XX = n.EID LEFT JOIN au ON p.XX = au.EID
    LEFT JOIN (SELECT EID, count(*) AS n_c1 FROM pub_institutions GROUP BY 1) f ON p.XX = f.EID""")
def _(c):
    d = cl.assemble_publications(c.pubs, c.pub_authors, c.cites, {"C1": c.pub_institutions})
    return d.select("XX", "PY", "TC", "AU1", "N_AU", "NR", F.size("CR").cast("long").alias("n_cr"),
                    F.size("C1").cast("long").alias("n_c1"), "SR")


@query("author_countries", """SELECT EID, string_agg(CN, ';' ORDER BY CN) AS AU_CO FROM (SELECT DISTINCT EID, CN FROM pub_countries) GROUP BY 1""")
def _(c):
    aff = c.pub_institutions.select("EID", F.concat(F.lit("Dept. of Trade, "), "C1", F.lit(", "), "C1_CN", F.lit(".")).alias("C1"))
    return cl.author_countries(aff, c.table("nation").select(F.col("n_name").alias("country")))


@query("nest_unnest", "SELECT EID, AU, pos FROM pub_authors")
def _(c):
    return fn.unnest(fn.nest(c.pub_authors, ["EID"], "AUS"), "AUS").select("EID", "AU", "pos")


@query("subset_by_name", "SELECT p_partkey AS SID, 'name,brand' AS names, p_name || '|' || p_brand AS vals FROM part")
def _(c):
    rec = F.create_map(F.lit("name"), "p_name", F.lit("type"), "p_type", F.lit("brand"), "p_brand")
    d = c.table("part").select(F.col("p_partkey").alias("SID"), cl.subset_by_name(rec, ["brand", "name"]).alias("r"))
    return d.select("SID", F.array_join(F.map_keys("r"), ",").alias("names"), F.array_join(F.map_values("r"), "|").alias("vals"))


@query("min_max_norm", """SELECT SID, round(CAST(TC - lo AS DOUBLE) / (hi - lo), 6) AS TC_norm FROM refs, (SELECT min(TC) AS lo, max(TC) AS hi FROM refs)""")
def _(c):
    return cl.min_max_norm(c.refs.select("SID", "TC"), "TC", "TC_norm").select("SID", F.round("TC_norm", 6).alias("TC_norm"))
