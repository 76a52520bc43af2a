"""Driver tables seen as a bibliographic corpus.

Every virtual table exists twice: as a lazy DataFrame (``Corpus``) and as SQL text
(``VIEWS``), from which ``with_views`` builds the oracle statements.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.session import cut_lineage

AS_OF_YEAR = 2024


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # publications -----------------------------------------------------------
    @cached_property
    def pubs(self) -> DataFrame:
        o = self.table("orders")
        c = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("SO"))
        return o.join(c, "o_custkey").select(
            F.col("o_orderkey").alias("XX"),
            F.year("o_orderdate").cast("long").alias("PY"),
            F.floor(F.col("o_totalprice") / 1000).cast("long").alias("TC"),
            F.col("o_orderpriority").alias("DT"),
            "SO",
            F.concat(F.lit("Study "), F.col("o_orderkey").cast("string"), F.lit(" on "),
                     F.col("o_orderpriority"), F.lit(" goods")).alias("TI"),
            (F.col("o_custkey") % 5).alias("batch"),
        )

    @cached_property
    def batches(self) -> DataFrame:
        """Publications plus a later batch that repeats some of them."""
        again = self.pubs.where(F.col("XX") % 11 == 0).withColumn("batch", F.lit(5).cast("long"))
        return self.pubs.unionByName(again)

    @cached_property
    def cites(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("EID"), F.col("l_partkey").alias("SID")).distinct()

    @cached_property
    def cites_dense(self) -> DataFrame:
        o = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("EID"))
        return self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("SID")).join(o, "l_orderkey").select("EID", "SID").distinct()

    @cached_property
    def pubs_dense(self) -> DataFrame:
        tc = self.table("orders").groupBy(F.col("o_custkey").alias("XX")).agg(F.count(F.lit(1)).alias("TC"))
        nr = self.cites_dense.groupBy(F.col("EID").alias("XX")).agg(F.count(F.lit(1)).alias("NR"))
        c = self.table("customer").select(
            F.col("c_custkey").alias("XX"), (F.lit(1995) + F.expr("c_custkey div 7") % 7).alias("PY"),
            F.col("c_mktsegment").alias("SO"), F.col("c_name").alias("TI"),
        )
        return c.join(tc, "XX").join(nr, "XX", "left").withColumn("NR", F.coalesce("NR", F.lit(0).cast("long")))

    @cached_property
    def refs(self) -> DataFrame:
        tc = self.cites.groupBy("SID").agg(F.count(F.lit(1)).alias("TC"))
        p = self.table("part").select(
            F.col("p_partkey").alias("SID"), F.col("p_brand").alias("SO"), F.col("p_name").alias("TI"),
            (F.lit(1960) + F.col("p_partkey") % 60).alias("PY"),
        )
        return p.join(tc, "SID", "left").withColumn("TC", F.coalesce("TC", F.lit(0).cast("long")))

    # child tables -----------------------------------------------------------
    @cached_property
    def pub_authors(self) -> DataFrame:
        s = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("AU"))
        return (
            self.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(s, "l_suppkey")
            .groupBy(F.col("l_orderkey").alias("EID"), "AU")
            .agg(F.min(F.col("l_linenumber").cast("long") * 10000000 + F.col("l_suppkey")).alias("pos"))
        )

    @cached_property
    def ref_authors(self) -> DataFrame:
        s = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("AU"))
        return (
            self.table("lineitem").select("l_partkey", "l_suppkey").distinct().join(s, "l_suppkey")
            .select(F.col("l_partkey").alias("SID"), "AU", F.col("l_suppkey").alias("pos"))
        )

    @cached_property
    def pub_institutions(self) -> DataFrame:
        """(EID, C1, C1_CN): affiliation and its country."""
        n = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("C1_CN"))
        s = self.table("supplier").join(n, "s_nationkey").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("C1"), "C1_CN"
        )
        return self.table("lineitem").select(F.col("l_orderkey").alias("EID"), "l_suppkey").join(s, "l_suppkey").select("EID", "C1", "C1_CN").distinct()

    @cached_property
    def pub_countries(self) -> DataFrame:
        """(EID, CN, pos): distinct countries with their first position."""
        n = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("CN"))
        s = self.table("supplier").join(n, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "CN")
        return (
            self.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(s, "l_suppkey")
            .groupBy(F.col("l_orderkey").alias("EID"), "CN")
            .agg(F.min(F.col("l_linenumber").cast("long") * 10000000 + F.col("l_suppkey")).alias("pos"))
        )

    @cached_property
    def pub_keywords(self) -> DataFrame:
        p = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("DE")
        )
        return self.table("lineitem").select(F.col("l_orderkey").alias("EID"), "l_partkey").join(p, "l_partkey").select("EID", "DE").distinct()

    def _dense(self, child: DataFrame) -> DataFrame:
        """Child rows of orders seen from their customer."""
        o = self.table("orders").select(F.col("o_orderkey").alias("EID"), F.col("o_custkey").alias("_c"))
        rest = [c for c in child.columns if c != "EID"]
        return child.join(o, "EID").select(F.col("_c").alias("EID"), *rest).distinct()

    @cached_property
    def authors_dense(self) -> DataFrame:
        return self._dense(self.pub_authors.select("EID", "AU"))

    @cached_property
    def institutions_dense(self) -> DataFrame:
        inst = F.concat(F.lit("Institute of applied research "), "C1", F.lit(" at "), "C1_CN").alias("C1")
        return self._dense(self.pub_institutions.select("EID", inst))

    @cached_property
    def keywords_dense(self) -> DataFrame:
        return self._dense(self.pub_keywords)

    # networks and given labels; stage tables, as several steps read each of them ------------------------------------------------
    @cached_property
    def bib_edges(self) -> DataFrame:
        from citespark.operators.network import bib_coupling
        return cut_lineage(bib_coupling(self.cites_dense, min_weight=3))

    @cached_property
    def cit_edges(self) -> DataFrame:
        from citespark.operators.network import co_citation
        return cut_lineage(co_citation(self.cites_dense, min_weight=4))

    @cached_property
    def labels(self) -> DataFrame:
        return self.pubs_dense.select(
            F.col("XX").alias("id"), (F.col("XX") % 7 + 1).alias("com"), (F.col("XX") % 3 + 1).alias("com2")
        )

    @cached_property
    def labels_cit(self) -> DataFrame:
        return self.refs.select(F.col("SID").alias("id"), (F.col("SID") % 5 + 1).alias("com"))

    @cached_property
    def members(self) -> DataFrame:
        """Labelled publications with attributes and internal degree."""
        from citespark.operators.network import internal_degree
        d = internal_degree(self.labels, self.bib_edges)
        return cut_lineage(self.pubs_dense.join(d.withColumnRenamed("id", "XX"), "XX"))

    @cached_property
    def ref_members(self) -> DataFrame:
        from citespark.operators.network import internal_degree
        d = internal_degree(self.labels_cit, self.cit_edges)
        return cut_lineage(self.refs.join(d.withColumnRenamed("id", "SID"), "SID"))

    # text ---------------------------------------------------------------------
    @cached_property
    def abstracts(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("EID"), (F.lit(1998) + F.col("doc_id") % 22).alias("PY"),
            F.col("source").alias("SO"), F.col("lang").alias("LA"), F.col("text").alias("AB"),
        )

    @cached_property
    def texts(self) -> DataFrame:
        """The abstracts dealt over all tasks: a file of few row groups is else cleaned and cut into words by few tasks."""
        return self.abstracts.repartition("EID")

    @cached_property
    def text_tidy(self) -> DataFrame:
        """A stage table: several steps of a query read it, and making it costs most of the query."""
        from citespark.operators.text import text_tidy
        return cut_lineage(text_tidy(self.texts, "EID", "AB"))

    @cached_property
    def beta(self) -> DataFrame:
        """Given topic-term table: term shares inside six fixed document classes."""
        t = self.text_tidy.groupBy((F.col("document") % 6 + 1).alias("topic"), "term").agg(F.sum("n").alias("n"))
        tot = t.groupBy("topic").agg(F.sum("n").alias("tot"))
        return t.join(tot, "topic").select("topic", "term", (F.col("n") / F.col("tot")).alias("beta"))

    @cached_property
    def gamma(self) -> DataFrame:
        """Given document-topic table: token shares by length class, 6 topics per document."""
        t = self.text_tidy.groupBy(
            "document", (F.length("term") % 6 + 1).cast("long").alias("topic")
        ).agg(F.sum("n").alias("n"))
        tot = t.groupBy("document").agg(F.sum("n").alias("tot"))
        return t.join(tot, "document").select("document", "topic", F.round(F.col("n") / F.col("tot"), 9).alias("gamma"))



VIEWS: dict[str, str] = {
    "pubs": """SELECT o_orderkey AS XX, CAST(year(o_orderdate) AS BIGINT) AS PY,
        CAST(floor(o_totalprice / 1000) AS BIGINT) AS TC, o_orderpriority AS DT, c_mktsegment AS SO,
        'Study ' || CAST(o_orderkey AS VARCHAR) || ' on ' || o_orderpriority || ' goods' AS TI,
        o_custkey % 5 AS batch
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "batches": "SELECT * FROM pubs UNION ALL SELECT XX, PY, TC, DT, SO, TI, CAST(5 AS BIGINT) AS batch FROM pubs WHERE XX % 11 = 0",
    "cites": "SELECT DISTINCT l_orderkey AS EID, l_partkey AS SID FROM lineitem",
    "cites_dense": "SELECT DISTINCT o_custkey AS EID, l_partkey AS SID FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "pubs_dense": """SELECT c_custkey AS XX, 1995 + (c_custkey // 7) % 7 AS PY, c_mktsegment AS SO, c_name AS TI, t.TC AS TC,
        coalesce(r.NR, 0) AS NR
        FROM customer JOIN (SELECT o_custkey, count(*) AS TC FROM orders GROUP BY 1) t ON c_custkey = t.o_custkey
        LEFT JOIN (SELECT EID, count(*) AS NR FROM cites_dense GROUP BY 1) r ON c_custkey = r.EID""",
    "refs": """SELECT p_partkey AS SID, p_brand AS SO, p_name AS TI, 1960 + p_partkey % 60 AS PY, coalesce(t.TC, 0) AS TC
        FROM part LEFT JOIN (SELECT SID, count(*) AS TC FROM cites GROUP BY 1) t ON p_partkey = t.SID""",
    "pub_authors": """SELECT l_orderkey AS EID, s_name AS AU, min(CAST(l_linenumber AS BIGINT) * 10000000 + l_suppkey) AS pos
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "ref_authors": """SELECT DISTINCT l_partkey AS SID, s_name AS AU, l_suppkey AS pos
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "pub_institutions": """SELECT DISTINCT l_orderkey AS EID, s_name AS C1, n_name AS C1_CN
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "pub_countries": """SELECT l_orderkey AS EID, n_name AS CN, min(CAST(l_linenumber AS BIGINT) * 10000000 + l_suppkey) AS pos
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "pub_keywords": """SELECT DISTINCT l_orderkey AS EID, lower(p_type || ' ' || p_name) AS DE
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "authors_dense": """SELECT DISTINCT o_custkey AS EID, s_name AS AU FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey""",
    "institutions_dense": """SELECT DISTINCT o_custkey AS EID, 'Institute of applied research ' || C1 || ' at ' || C1_CN AS C1
        FROM pub_institutions JOIN orders ON EID = o_orderkey""",
    "keywords_dense": "SELECT DISTINCT o_custkey AS EID, DE FROM pub_keywords JOIN orders ON EID = o_orderkey",
    "direct": """SELECT c.EID AS src, c.SID AS dst FROM cites c JOIN pubs a ON c.EID = a.XX JOIN pubs b ON c.SID = b.XX
        WHERE b.PY < a.PY""",
    "bib_edges": """SELECT a.EID AS src, b.EID AS dst, count(*) AS weight FROM cites_dense a JOIN cites_dense b
        ON a.SID = b.SID AND a.EID < b.EID GROUP BY 1, 2 HAVING count(*) >= 3""",
    "cit_edges": """SELECT a.SID AS src, b.SID AS dst, count(*) AS weight FROM cites_dense a JOIN cites_dense b
        ON a.EID = b.EID AND a.SID < b.SID GROUP BY 1, 2 HAVING count(*) >= 4""",
    "labels": "SELECT XX AS id, XX % 7 + 1 AS com, XX % 3 + 1 AS com2 FROM pubs_dense",
    "labels_cit": "SELECT SID AS id, SID % 5 + 1 AS com FROM refs",
    "bib_ends": """SELECT e.src AS id, e.weight, a.com, a.com2, b.com AS com_o, b.com2 AS com2_o FROM
        (SELECT src, dst, weight FROM bib_edges UNION ALL SELECT dst, src, weight FROM bib_edges) e
        JOIN labels a ON e.src = a.id JOIN labels b ON e.dst = b.id""",
    "node_deg": """SELECT l.id, l.com, l.com2, CAST(coalesce(sum(e.weight), 0) AS DOUBLE) AS dgr,
        CAST(coalesce(sum(e.weight) FILTER (WHERE e.com = e.com_o), 0) AS DOUBLE) AS dgr_int,
        CAST(coalesce(sum(e.weight) FILTER (WHERE e.com = e.com_o AND e.com2 = e.com2_o), 0) AS DOUBLE) AS dgr_int2
        FROM labels l LEFT JOIN bib_ends e ON l.id = e.id GROUP BY 1, 2, 3""",
    "members": "SELECT p.*, d.com, d.com2, d.dgr, d.dgr_int, d.dgr_int2 FROM pubs_dense p JOIN node_deg d ON p.XX = d.id",
    "cit_ends": """SELECT e.src AS id, e.weight, a.com, b.com AS com_o FROM
        (SELECT src, dst, weight FROM cit_edges UNION ALL SELECT dst, src, weight FROM cit_edges) e
        JOIN labels_cit a ON e.src = a.id JOIN labels_cit b ON e.dst = b.id""",
    "cit_deg": """SELECT l.id, l.com, CAST(coalesce(sum(e.weight), 0) AS DOUBLE) AS dgr,
        CAST(coalesce(sum(e.weight) FILTER (WHERE e.com = e.com_o), 0) AS DOUBLE) AS dgr_int
        FROM labels_cit l LEFT JOIN cit_ends e ON l.id = e.id GROUP BY 1, 2""",
    "ref_members": "SELECT p.*, d.com, d.dgr, d.dgr_int FROM refs p JOIN cit_deg d ON p.SID = d.id",
    "abstracts": """SELECT doc_id AS EID, 1998 + doc_id % 22 AS PY, source AS SO, lang AS LA, text AS AB FROM documents""",
    "text_clean": r"""SELECT EID AS document, trim(regexp_replace(regexp_replace(replace(regexp_replace(AB,
        '&(trade|reg|copy|#8482|#174|#169);', '', 'g'), '&', '-and-'), '[\s\p{Z}]+', ' ', 'g'), '�.*', '')) AS AB
        FROM abstracts WHERE AB IS NOT NULL""",
    "tokens": r"""SELECT document, term FROM (SELECT t.document, unnest(regexp_split_to_array(lower(t.AB), '[^\p{L}\p{N}]+')) AS term
        FROM text_clean t) WHERE term <> ''""",
    "text_tidy": """SELECT document, lemma AS term, count(*) AS n FROM (
        SELECT document, coalesce(d.lemma, term) AS lemma FROM tokens LEFT JOIN lemmas d ON term = d.token WHERE length(term) > 2)
        WHERE lemma NOT IN (SELECT word FROM stops) GROUP BY 1, 2""",
    "beta": """SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS beta FROM
        (SELECT document % 6 + 1 AS topic, term, CAST(sum(n) AS DOUBLE) AS n FROM text_tidy GROUP BY 1, 2)""",
    "gamma": """SELECT document, topic, round(n / sum(n) OVER (PARTITION BY document), 9) AS gamma FROM
        (SELECT document, CAST(length(term) % 6 + 1 AS BIGINT) AS topic, CAST(sum(n) AS DOUBLE) AS n FROM text_tidy GROUP BY 1, 2)""",
}


def _word_views() -> None:
    from citespark.operators.text import OWN_LEMMAS, STOP_WORDS
    stops = ", ".join("('" + w.replace("'", "''") + "')" for w in STOP_WORDS)
    lemmas = ", ".join(f"('{k}', '{v}')" for k, v in OWN_LEMMAS.items())
    VIEWS["stops"] = f"SELECT * FROM (VALUES {stops}) AS t(word)"
    VIEWS["lemmas"] = f"SELECT * FROM (VALUES {lemmas}) AS t(token, lemma)"


def with_views(body: str) -> str:
    """Prefix the statement with the virtual tables it (transitively) names."""
    import re

    if "stops" not in VIEWS:
        _word_views()
    order: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[A-Za-z_]\w*", text))
        for name in VIEWS:
            if name in words and name not in order and f" {name}" in " " + text:
                used = re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text)
                if used:
                    visit(VIEWS[name])
                    if name not in order:
                        order.append(name)

    visit(body)
    stripped = body.strip()
    if not order:
        return stripped
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if stripped[:5].upper() == "WITH ":
        return f"WITH {head}, {stripped[5:]}"
    return f"WITH {head} {stripped}"
