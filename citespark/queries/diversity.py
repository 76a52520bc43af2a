"""Diversity and cohesion indices."""

import re

from pyspark.sql import functions as F

from citespark.adapter import VIEWS
from citespark.operators import diversity as dv
from citespark.queries import query
from citespark.queries.series import BOUNDS, r6
from citespark.session import cut_lineage
from citespark.operators import twomode as tm
from citespark.queries.twomode import bib_ep, bib_panel, cit_panel, p2, p4, p6

WIDTH = 2


def _gini(src, by, x):
    return f"""(SELECT {by}, (2 * sum(i * x) / nullif(sum(x), 0) - (count(*) + 1)) / count(*) AS gini FROM
        (SELECT {by}, CAST({x} AS DOUBLE) AS x, row_number() OVER (PARTITION BY {by} ORDER BY {x}) AS i FROM {src}) GROUP BY {by})"""


@query("gini", f"SELECT com, round(gini, 6) AS gini FROM {_gini('members', 'com', 'dgr')}")
def _(c):
    return r6(dv.gini(c.members, ["com"], "dgr"), "gini")


def _window(i, b):
    return f"least(PY1, PY2) >= {b - WIDTH} AND greatest(PY1, PY2) < {b}" if b else "TRUE"


def _d2():
    parts = []
    for i, b in [*enumerate(BOUNDS, 1), (len(BOUNDS) + 1, None)]:
        upto = f"greatest(PY1, PY2) < {b}" if b else "TRUE"
        for com, cond in (("CAST(com1 AS VARCHAR)", "com1 = com2"), ("'X_all'", "TRUE")):
            parts.append(f"""SELECT {com} AS com, {i} AS P, CAST(coalesce(sum(2 * weight) FILTER (WHERE {_window(i, b)}), 0) AS DOUBLE) AS dgr_int,
                CAST(coalesce(sum(2 * weight) FILTER (WHERE {upto}), 0) AS DOUBLE) AS dgr_int_cum FROM bib_ep WHERE {cond} GROUP BY 1""")
    return " UNION ALL ".join(parts)


@query("internal_degree_by_period", _d2())
def _(c):
    return dv.internal_degree_by_period(bib_ep(c), BOUNDS, WIDTH)


VIEWS["totals"] = """WITH r AS (SELECT CAST(com AS VARCHAR) AS com, P, n, n_cum, dgr_int, dgr_int_cum FROM bib_panel),
    a AS (SELECT * FROM r UNION ALL SELECT 'X_all', P, CAST(sum(n) AS BIGINT), CAST(sum(n_cum) AS BIGINT), sum(dgr_int), sum(dgr_int_cum) FROM r GROUP BY P)
    SELECT * FROM a UNION ALL SELECT com, P + 1, n_cum, n_cum, dgr_int_cum, dgr_int_cum FROM a WHERE P = (SELECT max(P) FROM r)"""


@query("grand_total_rows", "SELECT * FROM totals")
def _(c):
    return dv.grand_total_rows(bib_panel(c))


@query("cohesion_internal", "SELECT com, P, n, round(CASE WHEN n > 1 THEN dgr_int / (n * (n - 1)) ELSE 0 END, 6) AS coh_int FROM totals")
def _(c):
    return r6(dv.cohesion_internal(dv.grand_total_rows(bib_panel(c))).select("com", "P", "n", "coh_int"), "coh_int")


def _index_sql(everyone, n, g, among):
    return f"""SELECT e.com, e.P, al.N AS N_all, CAST(coalesce(c.n, 0) AS BIGINT) AS n_own, coalesce(CAST(c.n AS DOUBLE) / al.N, 0) AS V, coalesce(g.b, 0) AS B,
        coalesce(1 - 2 * coalesce(m.w, 0) / nullif(c.n * (c.n - 1), 0), 1) AS D
        FROM {everyone} e JOIN nall al ON e.P = al.P LEFT JOIN {n} c ON e.com = c.com AND e.P = c.P
        LEFT JOIN {g} g ON e.com = g.com AND e.P = g.P LEFT JOIN {among} m ON e.com = m.com AND e.P = m.P"""


EVERY = "everyone AS (SELECT CAST(com AS VARCHAR) AS com, P FROM bib_panel UNION ALL SELECT DISTINCT 'X_all', P FROM bib_panel)"


INTERNAL = f"""WITH {EVERY}, nall AS (SELECT P, count(*) AS N FROM cit_panel WHERE n_cum > 0 GROUP BY 1),
    act AS (SELECT CAST(p6.com1 AS VARCHAR) AS com, p6.com2 AS id, p6.P, weight FROM p6 JOIN cit_panel q ON p6.com2 = q.com AND p6.P = q.P AND q.n_cum > 0
      JOIN bib_panel b ON p6.com1 = b.com AND p6.P = b.P AND b.n_cum > 0),
    mem AS (SELECT com, P, id FROM act WHERE weight >= 0.025 UNION ALL SELECT DISTINCT 'X_all', P, id FROM act WHERE weight >= 0.025),
    wts AS (SELECT com, P, weight FROM act WHERE weight >= 0.025 UNION ALL SELECT 'X_all', P, weight FROM act),
    nn AS (SELECT com, P, count(*) AS n FROM mem GROUP BY 1, 2), gg AS (SELECT com, P, 1 - gini AS b FROM {_gini('wts', 'com, P', 'weight')}),
    am AS (SELECT a.com, a.P, sum(e.weight) AS w FROM p4 e JOIN mem a ON e.P = a.P AND e.com1 = a.id JOIN mem b ON e.P = b.P AND e.com2 = b.id AND a.com = b.com GROUP BY 1, 2)
    SELECT com, P, N_all AS N_bases, n_own AS n, round(V, 6) AS V, round(B, 6) AS B, round(D, 6) AS D, round(V * B * D, 6) AS div_int FROM ({_index_sql('everyone', 'nn', 'gg', 'am')})"""


@query("diversity_internal", INTERNAL)
def _(c):
    stages = [cut_lineage(df) for df in (p6(c), p4(c), bib_panel(c), cit_panel(c))]
    return r6(dv.diversity_internal(*stages), "V", "B", "D", "div_int")


EXTERNAL = f"""WITH {EVERY}, nall AS (SELECT P, count(*) AS N FROM bib_panel WHERE n_cum > 0 GROUP BY 1),
    own AS (SELECT CAST(com1 AS VARCHAR) AS com, com2 AS id, P, weight FROM p2 UNION ALL SELECT CAST(com2 AS VARCHAR), com1, P, weight FROM p2),
    wts AS (SELECT com, P, weight FROM own UNION ALL SELECT 'X_all', P, weight FROM p2),
    nn AS (SELECT com, P, count(*) AS n FROM own GROUP BY 1, 2 UNION ALL SELECT 'X_all', P, N FROM nall), gg AS (SELECT com, P, gini AS b FROM {_gini('wts', 'com, P', 'weight')}),
    am AS (SELECT a.com, a.P, sum(e.weight) AS w FROM p2 e JOIN own a ON e.P = a.P AND e.com1 = a.id JOIN own b ON e.P = b.P AND e.com2 = b.id AND a.com = b.com GROUP BY 1, 2),
    dg AS (SELECT com, P, sum(weight) AS dgr FROM own GROUP BY 1, 2 UNION ALL SELECT 'X_all', P, sum(weight) FROM own GROUP BY P)
    SELECT i.com, i.P, N_all AS N_coms, n_own AS n, round(coalesce(dgr, 0), 6) AS dgr, round(V, 6) AS V, round(B, 6) AS B, round(D, 6) AS D, round(V * B * D, 6) AS div_ext,
    round(coalesce(dgr / nullif(N_all * (N_all - 1), 0), 0), 6) AS coh_ext FROM
    ({_index_sql('everyone', 'nn', 'gg', 'am')}) i LEFT JOIN dg ON i.com = dg.com AND i.P = dg.P"""


@query("diversity_external", EXTERNAL)
def _(c):
    d = dv.diversity_external(cut_lineage(p2(c)), cut_lineage(bib_panel(c)))
    return r6(d, "coh_ext", "div_ext", "dgr", "V", "B", "D")


# with the rows of all periods together, as the period after the last ---------------------------------
AFTER = "(SELECT max(P) + 1 FROM bib_panel)"
SUMMED = "SELECT com1, com2, {after}, w / max(w) OVER () FROM (SELECT com1, com2, sum(weight_adj) AS w FROM {name} GROUP BY 1, 2)"
VIEWS["p2a"] = f"SELECT com1, com2, P, weight FROM p2 UNION ALL {SUMMED.format(after=AFTER, name='p2')}"
VIEWS["p4a"] = f"SELECT com1, com2, P, weight FROM p4 UNION ALL {SUMMED.format(after=AFTER, name='p4')}"
VIEWS["p6a"] = f"SELECT com1, com2, P, weight FROM p6 UNION ALL SELECT com1, com2, {AFTER}, max(weight) FROM p6 GROUP BY 1, 2"
for _name in ("bib_panel", "cit_panel"):
    VIEWS[_name + "a"] = f"""SELECT com, P, n_cum FROM {_name} UNION ALL
    SELECT com, P + 1, n_cum FROM {_name} WHERE P = (SELECT max(P) FROM {_name})"""


def _all_periods(sql):
    for name in ("p2", "p4", "p6", "bib_panel", "cit_panel"):
        sql = re.sub(rf"\b{name}\b", name + "a", sql)
    return sql


@query("diversity_internal_all_periods", _all_periods(INTERNAL))
def _(c):
    links, bases, bib, cit = (cut_lineage(df) for df in (p6(c), p4(c), bib_panel(c), cit_panel(c)))
    links = tm.with_all_periods(links, tm.overall_two_mode_network(links), bib)
    bases = tm.with_all_periods(bases, tm.overall_cocitation_network(bases), bib)
    stages = [cut_lineage(df) for df in (links, bases, dv.panel_with_all_periods(bib), dv.panel_with_all_periods(cit))]
    return r6(dv.diversity_internal(*stages), "V", "B", "D", "div_int")


@query("diversity_external_all_periods", _all_periods(EXTERNAL))
def _(c):
    network, bib = cut_lineage(p2(c)), cut_lineage(bib_panel(c))
    network = cut_lineage(tm.with_all_periods(network, tm.overall_coupling_network(network), bib))
    d = dv.diversity_external(network, cut_lineage(dv.panel_with_all_periods(bib)))
    return r6(d, "coh_ext", "div_ext", "dgr", "V", "B", "D")


@query("cohesion_internal_cited", """WITH r AS (SELECT CAST(com AS VARCHAR) AS com, P, n, n_cum, dgr_int, dgr_int_cum FROM cit_panel),
    a AS (SELECT * FROM r UNION ALL SELECT 'X_all', P, CAST(sum(n) AS BIGINT), CAST(sum(n_cum) AS BIGINT), sum(dgr_int), sum(dgr_int_cum) FROM r GROUP BY P),
    t AS (SELECT * FROM a UNION ALL SELECT com, P + 1, n_cum, n_cum, dgr_int_cum, dgr_int_cum FROM a WHERE P = (SELECT max(P) FROM r))
    SELECT com, P, n, round(CASE WHEN n > 1 THEN 2 * dgr_int / (n * (n - 1)) ELSE 0 END, 6) AS coh_int FROM t""")
def _(c):
    return r6(dv.cohesion_internal(dv.grand_total_rows(cit_panel(c)), 2).select("com", "P", "n", "coh_int"), "coh_int")
