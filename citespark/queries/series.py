"""Time series."""

from pyspark.sql import functions as F

from citespark.adapter import VIEWS
from citespark.functions import period_of
from citespark.operators import network as nw
from citespark.operators import series as se
from citespark.queries import query

BOUNDS = (1996, 1998, 2000, 2002)          # periods that fit the publication years
CITED_BOUNDS = (1980, 1990, 2000, 2020)    # and the years of the cited works


def period_sql(col, bounds):
    return "CASE " + " ".join(f"WHEN {col} < {b} THEN {i}" for i, b in enumerate(bounds, 1)) + " END"


VIEWS["doc_nodes"] = "SELECT EID AS document, PY, EID % 7 + 1 AS com FROM abstracts"
VIEWS["two_mode"] = """SELECT x.EID AS a, x.SID AS b, l.com AS com_bib, r.com AS com_cit, p.PY FROM cites_dense x
    JOIN labels l ON x.EID = l.id JOIN labels_cit r ON x.SID = r.id JOIN pubs_dense p ON x.EID = p.XX"""


def doc_nodes(c):
    return c.abstracts.select("EID", "PY", (F.col("EID") % 7 + 1).alias("com"))


def two_mode(c):
    return nw.two_mode_edges(c.cites_dense, c.labels, c.labels_cit)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("series_with_share", """SELECT PY, SO, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY PY), 6) AS n_rel FROM
    (SELECT PY, SO, count(*) AS n FROM pubs WHERE PY BETWEEN 1996 AND 2000 GROUP BY 1, 2)""")
def _(c):
    return r6(se.series_with_share(c.pubs, "PY", "SO", t_min=1996, t_max=2000), "n_rel")


TOT = """SELECT PY, topic, round(w, 6) AS weight, round(w / sum(w) OVER (PARTITION BY PY), 6) AS weight_rel FROM
    (SELECT PY, topic, {}(gamma) AS w FROM gamma g JOIN doc_nodes d ON g.document = d.document {} GROUP BY 1, 2)"""


@query("topics_over_time", TOT.format("sum", ""))
def _(c):
    return r6(se.topics_over_time(c.gamma, doc_nodes(c)), "weight", "weight_rel")


@query("topics_over_time_mean", TOT.format("avg", "WHERE d.com IN (1, 4)"))
def _(c):
    return r6(se.topics_over_time(c.gamma, doc_nodes(c), "mean", [1, 4]), "weight", "weight_rel")


KB = """SELECT PY, com_cit, TC, round(CAST(TC AS DOUBLE) / sum(TC) OVER (PARTITION BY PY), 6) AS TC_rel FROM
    (SELECT PY, com_cit, count(*) AS TC FROM two_mode WHERE {} GROUP BY 1, 2)"""


@query("knowledge_base_over_time", KB.format("TRUE"))
def _(c):
    return r6(se.knowledge_base_over_time(two_mode(c), c.pubs_dense), "TC_rel")


@query("knowledge_base_over_time_com", KB.format("com_bib = 2"))
def _(c):
    return r6(se.knowledge_base_over_time(two_mode(c), c.pubs_dense, [2]), "TC_rel")


@query("timeline_prepare", """WITH s AS (SELECT PY, SO, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY PY) AS n_rel FROM
    (SELECT PY, SO, count(*) AS n FROM pubs GROUP BY 1, 2)), f AS (SELECT * FROM s WHERE SO IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND PY BETWEEN 1996 AND 2000)
    SELECT PY, SO, n, round(n_rel, 6) AS n_rel, round(CASE WHEN PY = (SELECT max(PY) FROM f) THEN sum(n_rel) OVER (PARTITION BY PY ORDER BY SO DESC) - n_rel / 2 ELSE -1 END, 6) AS pos FROM f""")
def _(c):
    s = se.series_with_share(c.pubs, "PY", "SO")
    d = se.timeline_prepare(s, "PY", "n", "n_rel", "SO", ["BUILDING", "MACHINERY", "FURNITURE"], 1996, 2000)
    return r6(d.withColumn("pos", F.coalesce("pos", F.lit(-1.0))), "n_rel", "pos")


@query("period_bucket", f"SELECT XX, PY, coalesce({period_sql('PY', (1996, 1998, 2000))}, -1) AS P FROM pubs")
def _(c):
    return c.pubs.select("XX", "PY", F.coalesce(period_of("PY", (1996, 1998, 2000)), F.lit(-1)).alias("P"))


def _panel_sql(src, t, nr=True):
    cols = ["n", "TC"] + (["NR"] if nr else []) + ["dgr", "dgr_int"]
    sums = ", ".join(f"CAST(sum({x}) AS {'DOUBLE' if x.startswith('dgr') else 'BIGINT'}) AS {x}" for x in cols[1:])
    fill = ", ".join(f"coalesce(a.{x}, 0) AS {x}" for x in cols)
    cum = ", ".join(
        f"CAST(sum({x}) OVER w AS {'DOUBLE' if x.startswith('dgr') else 'BIGINT'}) AS {x}_cum" for x in [*cols, "dgr_ext"])
    return f"""SELECT *, round(CASE WHEN dgr_cum > 0 THEN dgr_int_cum / dgr_cum ELSE 0 END, 2) AS dgr_ratio FROM (SELECT *, {cum} FROM
        (SELECT *, dgr - dgr_int AS dgr_ext FROM (SELECT g.com, g.{t}, {fill} FROM (SELECT * FROM (SELECT DISTINCT com FROM {src}), (SELECT DISTINCT {t} FROM {src})) g
        LEFT JOIN (SELECT com, {t}, count(*) AS n, {sums} FROM {src} GROUP BY 1, 2) a ON g.com = a.com AND g.{t} = a.{t}))
        WINDOW w AS (PARTITION BY com ORDER BY {t}))"""


VIEWS["bib_nodes"] = f"SELECT *, {period_sql('PY', BOUNDS)} AS P FROM members"
VIEWS["cit_nodes"] = f"SELECT *, {period_sql('PY', CITED_BOUNDS)} AS P FROM ref_members"
VIEWS["bib_panel"] = _panel_sql("bib_nodes", "P")
VIEWS["cit_panel"] = _panel_sql("cit_nodes", "P", nr=False)

CIT_SUMS = ("TC", "dgr", "dgr_int")


@query("community_year_panel", f"SELECT *, {period_sql('PY', BOUNDS)} AS P FROM ({_panel_sql('members', 'PY')}) WHERE PY BETWEEN 1996 AND 2000")
def _(c):
    return se.community_year_panel(c.members, 1996, 2000, BOUNDS)


@query("community_period_panel", "SELECT * FROM bib_panel")
def _(c):
    return se.community_period_panel(c.members, BOUNDS)


@query("cited_year_panel", f"SELECT *, {period_sql('PY', CITED_BOUNDS)} AS P FROM ({_panel_sql('ref_members', 'PY', nr=False)})")
def _(c):
    return se.community_year_panel(c.ref_members, bounds=CITED_BOUNDS, sums=CIT_SUMS)


@query("cited_period_panel", "SELECT * FROM cit_panel")
def _(c):
    return se.community_period_panel(c.ref_members, CITED_BOUNDS, CIT_SUMS)


# themes with words that occur in the driver's documents
DEMO_THEMES = {
    "Theory": [["thth.*|whst", "tion|ing .*re"]],
    "Place": [["urban.*|les|des"]],
    "Action": [["heed"], ["hein", "onsh"]],
    "Never": [["zzzqq"]],
}


def _flag_sql(themes):
    def m(p):
        return f"regexp_matches(lower(AB), '{p}')"
    return ", ".join(
        "(" + " OR ".join("(" + " AND ".join(m(p) for p in alt) + ")" for alt in alts) + f") AS {name}" for name, alts in themes.items())


def _series_sql(themes):
    each = " UNION ALL ".join(f"SELECT PY, '{n}' AS content, count(*) FILTER (WHERE {n}) AS n FROM f GROUP BY 1" for n in themes)
    return f"""WITH f AS (SELECT PY, {_flag_sql(themes)} FROM abstracts), u AS ({each})
    SELECT PY, content, n, round(coalesce(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY PY), 0), NULL), 6) AS n_rel FROM u"""


def _register_themes(suffix, themes):
    @query("keyword_flags" + suffix, f"SELECT EID, PY, {_flag_sql(themes)} FROM abstracts")
    def _(c):
        return se.keyword_flags(c.abstracts.select("EID", "PY", "AB"), "AB", themes)

    @query("keyword_series" + suffix, _series_sql(themes))
    def _(c):
        flags = se.keyword_flags(c.abstracts.select("EID", "PY", "AB"), "AB", themes)
        return r6(se.keyword_series(flags, list(themes)), "n_rel")


_register_themes("", se.THEMES)
_register_themes("_frequent", DEMO_THEMES)
