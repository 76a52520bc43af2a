"""Reference strings made of the adapter's citations, with planted errors, linked back to the cited works."""

from pyspark.sql import functions as F

from citespark.operators import indicators as ind
from citespark.operators import linkage as ln
from citespark.operators import network as nw
from citespark.queries import query

# Two works in a hundred agree in everything. Errors by (citing + 7 * cited) % 10: a letter of the name lost, a word of the
# title lost, the year one too late, the year lost, all in capitals.
WORK = """SELECT {k} AS XX, {name} AS AU1, CAST(1960 + {b} % 60 AS INT) AS PY, {words} AS TI FROM part"""
PARTS = {"b": "(p_partkey - CASE WHEN p_partkey % 100 = 1 THEN 1 ELSE 0 END)", "k": "p_partkey"}


def _made(text: str) -> str:
    b = PARTS["b"]
    word = [f"substr(md5(CAST({b} AS {text})), {1 + 7 * i}, 7)" for i in range(3)]
    return WORK.format(k="p_partkey", b=b, name=f"concat('N', substr(md5(CAST({b} % 800 AS {text})), 1, 6), ' A.')",
                       words=f"concat('A study of ', {word[0]}, ' and ', {word[1]}, ' in ', {word[2]})")


CITED = """SELECT DISTINCT l_orderkey AS EID, XX AS SID, CASE (l_orderkey + 7 * XX) % 10
    WHEN 0 THEN concat(substr(AU1, 1, 2), substr(AU1, 4), ', ', TI, ', (', PY, ') Journal, 3, pp. 1-9')
    WHEN 1 THEN concat(AU1, ', ', substr(TI, 1, 10), substr(TI, 19), ', (', PY, ') Journal, 3, pp. 1-9')
    WHEN 2 THEN concat(AU1, ', ', TI, ', (', PY + 1, ') Journal')
    WHEN 3 THEN concat(AU1, ', ', TI, ', Journal, 3')
    WHEN 4 THEN upper(concat(AU1, ', ', TI, ': (', PY, ') Journal'))
    ELSE concat(AU1, ', ', TI, ', (', PY, ') Journal, 3, pp. 1-9') END AS CR FROM lineitem JOIN works ON l_partkey = XX"""

LINKED = rf"""works AS ({_made('VARCHAR')}), strings AS ({CITED}),
    heads AS (SELECT CR AS ref, nullif(regexp_extract(CR, '\(((?:18|19|20)\d\d)\)', 1), '') AS y FROM (SELECT DISTINCT CR FROM strings)),
    plain AS (SELECT ref, CAST(y AS INT) AS year, trim(regexp_replace(lower(CASE WHEN y IS NULL THEN ref
        ELSE split_part(ref, '(' || y || ')', 1) END), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS head FROM heads),
    crefs AS (SELECT ref, year, split_part(head, ' ', 1) AS author,
        list_distinct(list_filter(string_split(head, ' '), lambda w: length(w) >= 3)) AS words FROM plain),
    titles AS (SELECT XX AS id, split_part(trim(regexp_replace(lower(AU1), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ', 1) AS name, PY AS y,
        list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(TI), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '),
        lambda w: length(w) >= 3))) AS title FROM works),
    classes AS (SELECT name, y, title, min(id) AS id, count(*) AS n FROM titles GROUP BY 1, 2, 3),
    tw AS (SELECT id, unnest(title) AS w FROM classes), df AS (SELECT w, count(*) AS df FROM tw GROUP BY 1),
    keys AS (SELECT id, w FROM tw JOIN df USING (w) QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, w) <= 3),
    rw AS (SELECT ref, unnest(words) AS w FROM crefs),
    near AS (SELECT DISTINCT ref, id FROM rw JOIN keys USING (w)),
    good AS (SELECT ref, id, n, CAST(len(list_intersect(title, words)) AS DOUBLE) / len(title) AS score, year = y AS ye, author = name AS ae
        FROM near JOIN crefs USING (ref) JOIN classes USING (id)
        WHERE (year = y OR author = name) AND abs(year - y) <= 1 AND levenshtein(author, name) <= 1),
    top AS (SELECT ref, score, sum(n) AS n, min(id) AS id FROM good WHERE score >= 0.7::DOUBLE GROUP BY ref, score, ye, ae
        QUALIFY row_number() OVER (PARTITION BY ref ORDER BY score DESC, ye DESC, ae DESC) = 1),
    linked AS (SELECT r.ref, CASE WHEN n = 1 THEN id END AS id, score,
        CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status
        FROM crefs r LEFT JOIN top t ON r.ref = t.ref)"""


def reference_strings(c):
    """(works, citations with their strings)."""
    c.table("part").createOrReplaceTempView("_parts")
    works = c.spark.sql(_made("STRING").replace("FROM part", "FROM _parts"))
    works.createOrReplaceTempView("_works")
    c.table("lineitem").createOrReplaceTempView("_lines")
    return works, c.spark.sql(CITED.replace("FROM lineitem JOIN works", "FROM _lines JOIN _works"))


@query("resolve_references", f"WITH {LINKED} SELECT ref, id, round(score, 6) AS score, status FROM linked")
def _(c):
    works, strings = reference_strings(c)
    return ln.resolve_references(works, strings).withColumn("score", F.round("score", 6))


@query("local_citations_from_strings", f"""WITH {LINKED}, hits AS (SELECT DISTINCT EID, id FROM strings JOIN linked ON CR = ref
    WHERE status = 'matched') SELECT id AS XX, PY, count(*) AS LCS FROM hits JOIN works ON id = XX GROUP BY 1, 2""")
def _(c):
    """Citations received inside the corpus, counted from the strings of the exports."""
    works, strings = reference_strings(c)
    cites = ln.resolved_citations(strings, ln.resolve_references(works, strings))
    citing = c.table("orders").select(F.col("o_orderkey").alias("XX"), F.lit(9999).alias("PY"))
    pairs = nw.direct_citation_network(
        cites.select(F.concat(F.lit("o"), "EID").alias("EID"), F.concat(F.lit("w"), "SID").alias("SID")),
        citing.select(F.concat(F.lit("o"), "XX").alias("XX"), "PY").union(works.select(F.concat(F.lit("w"), "XX"), "PY")))
    found = ind.local_citations(pairs.withColumn("dst", F.substring("dst", 2, 20).cast("long")),
                                works.withColumn("TC", F.lit(0)))
    return found.select("XX", "PY", "LCS")
