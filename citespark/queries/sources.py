"""Sources and sinks: files are written from the tables into a fresh folder and read back."""

from pyspark.sql import functions as F

from citespark.functions import nest, unnest
from citespark.operators import network as nw
from citespark.queries import query
from citespark.session import fresh_path
from citespark.sources import exports as ex
from citespark.sources import records as rec


FAST_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _write_batches(c):
    """One export folder per batch, ``scopus_<n>.csv``, as the file loop of a download would leave them."""
    root = fresh_path(c.spark, "exports")
    df = c.batches.select(
        F.col("XX").cast("string").alias("EID"), "TI", "SO", "DT", "TC", "PY", F.concat_ws("; ", "SO", "DT").alias("DE"),
        F.concat_ws(", ", F.lit("Smith"), "SO").alias("AU"), "batch")
    for b in range(6):
        ex.write_export(df.where(F.col("batch") == b).drop("batch"), f"{root}/scopus_{b}.csv")
    return root


@query("read_collection", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY XX) AS k FROM batches WHERE TC >= 50 AND PY BETWEEN 1996 AND 2000),
    g AS (SELECT *, row_number() OVER (PARTITION BY XX ORDER BY batch) AS rn FROM f WHERE k <= 1000 AND DT IN ('1-URGENT', '2-HIGH', '5-LOW'))
    SELECT CAST(XX AS VARCHAR) AS XX, PY, TC, DT, batch FROM g WHERE rn = 1""")
def _(c):
    d = ex.read_collection(c.spark, _write_batches(c) + "/scopus_*.csv", 50, 1996, 2000, 1000, ["1-URGENT", "2-HIGH", "5-LOW"], pos="EID")
    return d.select("XX", "PY", "TC", "DT", "batch")


@query("file_glob", "SELECT batch, count(*) AS n FROM batches GROUP BY 1")
def _(c):
    root = _write_batches(c)
    c.table("region").select(F.col("r_name").alias("EID")).write.json(root + "/other_1.csv")  # refused by the filter on file names
    d = ex._read_tags(c.spark, root + "/*", ["EID"], "*.csv").withColumn("batch", ex.batch_number())
    return d.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("read_scopus", """SELECT CAST(XX AS VARCHAR) AS EID, 'Smith et al.' AS AU1_kind, PY, TC, round(CAST(TC AS DOUBLE) / (2024 - PY + 1), 2) AS TC_year, lower(SO) || '|' || lower(DT) AS DE
    FROM pubs WHERE TC >= 20 AND PY >= 1996 AND DT <> '5-LOW'""")
def _(c):
    d = ex.read_scopus(c.spark, _write_batches(c) + "/scopus_*.csv", type="reduced", tc_min=20, py_min=1996, exclude=[("DT", "5-LOW")])
    kind = F.when(F.col("AU_NR") == 2, F.lit("Smith et al."))
    return d.select("EID", kind.alias("AU1_kind"), "PY", "TC", "TC_year", F.array_join("DE", "|").alias("DE"))


@query("seed_index", "SELECT DISTINCT p_name AS index FROM part WHERE p_size > 10")
def _(c):
    path = fresh_path(c.spark, "index")
    ex.write_csv(c.table("part").select(F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("index")), path)
    return ex.seed_index(c.spark, path)


@query("stage_tables", "SELECT * FROM refs")
def _(c):
    path = fresh_path(c.spark, "refs")
    ex.save_stage(c.refs, path)
    return ex.load_stage(c.spark, path)


def _store(c):
    path = fresh_path(c.spark, "abstracts")
    d = c.abstracts.select(
        F.col("EID").cast("string").alias("EID"), "PY", F.col("SO").alias("TI"), F.array("LA", "SO").alias("DE"),
        F.array("LA").alias("ID"), F.when(F.length("AB") > 400, F.col("AB")).alias("AB"))
    ex.append_abstracts(d.where(F.col("PY") < 2010), path)
    ex.append_abstracts(d, path)
    return path


@query("abstract_table_sink", "SELECT CAST(EID AS VARCHAR) AS EID, PY, SO AS TI, LA || '; ' || SO AS DE, LA AS ID, md5(AB) AS h FROM abstracts WHERE length(AB) > 400")
def _(c):
    d = ex.scan_abstracts(c.spark, _store(c))
    return d.select("EID", "PY", "TI", "DE", "ID", F.md5("AB").alias("h"))


@query("abstract_table_scan", "SELECT PY, count(*) AS n FROM abstracts WHERE length(AB) > 400 GROUP BY 1")
def _(c):
    return ex.scan_abstracts(c.spark, _store(c)).groupBy("PY").agg(F.count(F.lit(1)).alias("n"))


@query("export_ids_csv", "SELECT CAST(p.XX AS VARCHAR) AS EID, p.TI AS SR, CAST(l.com AS VARCHAR) AS com, CAST(l.com2 AS VARCHAR) AS com2 FROM pubs p LEFT JOIN labels l ON p.XX = l.id")
def _(c):
    path = fresh_path(c.spark, "ids")
    ids = c.pubs.select(F.col("XX").alias("EID"), F.col("TI").alias("SR"))
    ex.write_csv(ex.export_ids(ids, c.labels), path)
    return c.spark.read.option("header", True).csv(path)


@query("export_edgelist_csv", """SELECT a.TI AS i, b.TI AS j, CAST(round(CAST(e.weight AS DOUBLE) / (a.NR + b.NR - e.weight), 3) AS DOUBLE) AS weight, e.weight AS weight_count
    FROM bib_edges e JOIN pubs_dense a ON e.src = a.XX JOIN pubs_dense b ON e.dst = b.XX""")
def _(c):
    path = fresh_path(c.spark, "edgelist")
    edges = nw.coupling_jaccard(c.bib_edges, c.pubs_dense)
    ex.write_csv(ex.export_edgelist(edges, c.pubs_dense.select(F.col("XX").alias("id"), F.col("TI").alias("name"))), path)
    return c.spark.read.option("header", True).schema("i string, j string, weight double, weight_count long").csv(path)


@query("incremental_fetch_plan", "SELECT DISTINCT l_partkey AS EID FROM lineitem WHERE l_partkey NOT IN (SELECT XX FROM pubs WHERE PY < 1999)")
def _(c):
    wanted = c.table("lineitem").select(F.col("l_partkey").alias("EID"))
    return ex.incremental_fetch_plan(wanted, c.pubs.where(F.col("PY") < 1999).select(F.col("XX").alias("EID")))


@query("graph_table_export", "SELECT src, dst, CAST(1 AS DOUBLE) AS weight, CAST(a.id AS VARCHAR) AS label_src FROM bib_edges JOIN labels a ON src = a.id")
def _(c):
    path = fresh_path(c.spark, "graph")
    ex.write_graph(c.labels, c.bib_edges.select("src", "dst"), path)
    nodes = c.spark.read.parquet(path + "/nodes")
    return nw.attach_to_ends(c.spark.read.parquet(path + "/edges"), nodes, ["label"], suffixes=("_src", "_dst")).select("src", "dst", "weight", "label_src")


# nested records -------------------------------------------------------------------
def _records(c):
    """JSON records built from orders and their lines, written compressed and read back."""
    path = fresh_path(c.spark, "records")
    p = c.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    s = c.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    n = c.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    # plain columns travel to their order, the small tables join them there; the parts of the record are made in its row
    li = c.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(p, "l_partkey")
    li = li.repartition("l_orderkey").join(s, "l_suppkey").join(n, "s_nationkey")

    def text(x):
        return x.cast("string")

    def line_parts(x):
        author = F.struct(
            F.concat(x["s_name"], F.lit("  J.A.")).alias("ce:indexed-name"), text(x["l_suppkey"]).alias("@auid"),
            F.struct(text(x["s_nationkey"]).alias("@id")).alias("affiliation"))
        aff = F.struct(
            x["s_name"].alias("affilname"), text(x["l_suppkey"]).alias("@id"),
            F.concat(F.lit("City of "), x["n_name"]).alias("affiliation-city"), x["n_name"].alias("affiliation-country"))
        subject = F.struct(x["p_type"].alias("$"), text(F.length(x["p_type"])).alias("@code"), F.substring(x["p_type"], 1, 4).alias("@abbrev"))
        ref = F.struct(F.struct(
            F.struct(F.struct(F.when(x["l_partkey"] % 10 != 0, text(x["l_partkey"])).otherwise("NULL").alias("$")).alias("itemid")).alias("refd-itemidlist"),
            F.struct(F.when(x["l_partkey"] % 3 == 0, F.lit("n.d.")).otherwise(text(1960 + x["l_partkey"] % 60)).alias("@first")).alias("ref-publicationyear"),
            F.struct(F.concat(F.lit("  "), x["p_name"]).alias("ref-titletext")).alias("ref-title"),
            x["p_brand"].alias("ref-sourcetitle"),
            F.struct(F.array(F.struct(F.lit("Dosi").alias("ce:indexed-name")), F.struct(x["p_type"].alias("ce:indexed-name"))).alias("author")).alias("ref-authors"),
        ).alias("ref-info"))
        return F.struct(x["l_linenumber"].alias("l_linenumber"), author.alias("a"), aff.alias("f"), subject.alias("s"), ref.alias("r"))

    # one order is one record; an order too long for one array becomes several records
    lines = nest(li, ["l_orderkey"], "L").withColumn("L", F.sort_array(F.transform("L", line_parts)))
    g = lines.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.array_distinct(F.transform("L", lambda x: F.struct(x["l_linenumber"].alias("k"), x["a"].alias("a")))).alias("au"),
        F.array_distinct(F.col("L.f")).alias("af"), F.array_distinct(F.col("L.s")).alias("sc"), F.col("L.r").alias("cr"))
    o = c.table("orders").join(g, "o_orderkey")
    fund = F.when(F.col("o_custkey") % 4 != 0, F.struct(
        F.array(F.struct(F.col("o_orderpriority").alias("xocs:funding-agency-matched-string"), F.substring("o_orderpriority", 3, 3).alias("xocs:funding-agency-acronym"),
                         text(F.col("o_custkey")).alias("xocs:funding-agency-id"), F.lit("character()").alias("xocs:funding-agency-country"))).alias("xocs:funding"),
        F.concat(F.lit("Funded  by "), "o_orderpriority").alias("xocs:funding-text")))
    ids = F.array(
        F.struct(F.lit("PUI").alias("@idtype"), text(F.col("o_custkey")).alias("$")),
        F.struct(F.lit("SGR").alias("@idtype"), text(F.col("o_orderkey") + 5000000).alias("$")))

    def record(affiliation):
        return F.to_json(F.struct(
            F.struct(text(F.col("o_orderkey")).alias("eid"), text(F.col("o_custkey")).alias("source-id")).alias("coredata"),
            F.struct(F.col("au.a").alias("author")).alias("authors"), affiliation.alias("affiliation"),
            F.struct(F.col("sc").alias("subject-area")).alias("subject-areas"),
            F.struct(
                F.struct(F.struct(F.struct(ids.alias("itemid")).alias("itemidlist")).alias("item-info"),
                         F.struct(F.struct(F.col("cr").alias("reference")).alias("bibliography")).alias("tail")).alias("bibrecord"),
                F.struct(fund.alias("xocs:funding-list")).alias("xocs:meta")).alias("item")))

    line = F.when(F.size("af") == 1, record(F.get("af", 0))).otherwise(record(F.col("af")))
    o.select(line.alias("value")).write.options(**FAST_GZIP).text(path)
    return rec.read_records(c.spark, path)


@query("read_records_json", "SELECT CAST(o_orderkey AS VARCHAR) AS EID, CAST(o_custkey AS VARCHAR) AS SO_ID FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(c):
    return _records(c).select("EID", F.col("coredata.source-id").alias("SO_ID"))


RAU = """ra AS (SELECT DISTINCT l_orderkey, l_linenumber AS pos, s_name || ' J' AS AU, CAST(l_suppkey AS VARCHAR) AS AU_ID, CAST(s_nationkey AS VARCHAR) AS AU_C1_ID FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query("extract_authors", f"""WITH {RAU} SELECT CAST(l_orderkey AS VARCHAR) AS EID, AU, AU_ID, AU_C1_ID, count(*) AS n FROM ra GROUP BY 1, 2, 3, 4""")
def _(c):
    d = unnest(rec.extract_authors(_records(c)).select("EID", "AU"), "AU")
    return d.groupBy("EID", "AU", "AU_ID", "AU_C1_ID").agg(F.count(F.lit(1)).alias("n"))


@query("extract_authors_entity", f"""WITH {RAU} SELECT AU_ID, count(*) AS n FROM ra GROUP BY 1""")
def _(c):
    return rec.extract_authors(_records(c), "entity").groupBy("AU_ID").agg(F.sum(F.size("DOC")).cast("long").alias("n"))


@query("extract_affiliations", """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS EID, s_name AS C1, CAST(l_suppkey AS VARCHAR) AS C1_ID, 'City of ' || n_name AS C1_CT, n_name AS C1_CN
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def _(c):
    return unnest(rec.extract_affiliations(_records(c)), "C1").select("EID", "C1", "C1_ID", "C1_CT", "C1_CN")


@query("extract_subjects", """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS EID, p_type AS SC, CAST(length(p_type) AS VARCHAR) AS SC_ID, substr(p_type, 1, 4) AS SC_CODE
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(c):
    return rec.extract_subjects(_records(c))


@query("extract_funding", """SELECT CAST(o_orderkey AS VARCHAR) AS EID, coalesce(CASE WHEN o_custkey % 4 <> 0 THEN o_orderpriority END, 'none') AS FX,
    coalesce(CASE WHEN o_custkey % 4 <> 0 THEN 'Funded by ' || o_orderpriority END, 'none') AS FX_TXT, 'none' AS FX_CN FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def _(c):
    d = rec.extract_funding(_records(c))
    return d.select("EID", *[F.coalesce(x, F.lit("none")).alias(x) for x in ("FX", "FX_TXT", "FX_CN")])


@query("extract_core_ids", "SELECT CAST(o_orderkey AS VARCHAR) AS EID, CAST(o_custkey AS VARCHAR) AS SO_ID, CAST(o_orderkey + 5000000 AS VARCHAR) AS SID FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(c):
    return rec.extract_core_ids(_records(c))


@query("extract_references", """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS EID, CAST(l_partkey AS VARCHAR) AS CR_SID, CASE WHEN l_partkey % 3 <> 0 THEN 1960 + l_partkey % 60 ELSE -1 END AS CR_PY,
    p_name AS CR_TI, p_brand AS CR_SO, 'Dosi G & ' || p_type AS CR_AU1, CAST(2 AS BIGINT) AS CR_N_AU FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 10 <> 0""")
def _(c):
    d = rec.extract_references(_records(c))
    return d.withColumn("CR_PY", F.coalesce("CR_PY", F.lit(-1).cast("long")))


ENTRIES_OF_A_FILE = 50_000  # a file of entries is read whole by one task


@query("records_xml", """WITH a AS (SELECT EID, string_agg(AU || ' X', '|' ORDER BY AU) AS authors FROM (SELECT DISTINCT EID, AU FROM pub_authors) GROUP BY 1),
    k AS (SELECT EID, string_agg(CN, '|' ORDER BY CN) AS countries FROM (SELECT DISTINCT EID, CN FROM pub_countries) GROUP BY 1)
    SELECT CAST(p.XX AS VARCHAR) AS scopusID, a.authors, k.countries, CAST(p.PY AS VARCHAR) AS year, p.TI AS articletitle, p.SO AS journal, p.SO || '|' || p.DT AS keywords, CAST(p.TC AS VARCHAR) AS timescited
    FROM pubs p JOIN a ON p.XX = a.EID JOIN k ON p.XX = k.EID""")
def _(c):
    path = fresh_path(c.spark, "entries")
    au = nest(c.pub_authors.select("EID", "AU"), ["EID"], "a").withColumn("a", F.col("a.AU"))
    cn = nest(c.pub_countries.select("EID", "CN"), ["EID"], "k").withColumn("k", F.col("k.CN"))
    p = c.pubs.withColumnRenamed("XX", "EID").join(au.join(cn, "EID", "full"), "EID")
    p.select(
        F.col("EID").cast("string").alias("eid"), F.transform("a", lambda x: F.struct(x.alias("surname"), F.lit("X").alias("initials"))).alias("author"),
        F.transform("k", lambda x: F.struct(x.alias("affiliation-country"))).alias("affiliation"),
        F.concat(F.col("PY").cast("string"), F.lit("-01-31")).alias("coverDate"), F.col("TI").alias("title"), F.col("SO").alias("publicationName"),
        F.concat_ws(" | ", "SO", "DT").alias("authkeywords"), F.col("TC").cast("string").alias("citedby-count"),
    ).write.format("xml").options(**{"rowTag": "entry", "rootTag": "feed", "maxRecordsPerFile": ENTRIES_OF_A_FILE, **FAST_GZIP}).save(path)
    d = rec.flatten_entries(rec.read_entries(c.spark, path))
    return d.select("scopusID", "authors", "countries", "year", "articletitle", "journal", "keywords", "timescited")
