"""Queries on treatment effects, matching, splits and placebos."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimators as E
from ..operators import group_time as G
from ..operators import hetero as H
from ..operators import matching as M
from ..operators import placebos as P
from ..operators import resample as X
from ..operators.gram import fe_ols, result_frame
from ..operators.greedy import match_scores
from ..operators.stages import stage
from ..sources.files import Parameters
from .domain import FIRST, LAST, PANEL, PANEL_ROLES, ROLES, panel_cy, panel_roles
from .ols_sql import coefficients, fe_sql, logit_sql
from .registry import query

# On a balanced panel two-way effects are swept out by subtracting unit and period means and adding the overall mean.
_SWEPT = f"""{PANEL}, s AS (SELECT id, year, g, k,
  y - avg(y) OVER (PARTITION BY id) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS yy,
  d - avg(d) OVER (PARTITION BY id) - avg(d) OVER (PARTITION BY year) + avg(d) OVER () AS dd FROM panel),
b AS (SELECT sum(dd * yy) / sum(dd * dd) AS beta, sum(dd * dd) AS sdd FROM s)"""


@query(
    "did_customer_year",
    f"""WITH {_SWEPT}, c AS (SELECT id, sum(dd * (yy - beta * dd)) AS u FROM s, b GROUP BY 1)
SELECT 'd' AS term, round(max(beta), 6) AS coef, round(sqrt(sum(u * u)) / max(sdd), 6) AS se, (SELECT count(*) FROM panel) AS nobs, count(*) AS n_entities FROM c, b""",
)
def _(spark, sf):
    fit = fe_ols(panel_cy(spark, sf), "y", ["d"], "id", "year")
    return result_frame(spark, fit.rows()).select("term", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"), "nobs", "n_entities")


@query(
    "did_cluster_year",
    f"""WITH {_SWEPT}, c AS (SELECT year, sum(dd * (yy - beta * dd)) AS u FROM s, b GROUP BY 1) SELECT 'd' AS term, round(max(beta), 6) AS coef, round(sqrt(sum(u * u)) / max(sdd), 6) AS se FROM c, b""",
)
def _(spark, sf):
    return result_frame(spark, fe_ols(panel_cy(spark, sf), "y", ["d"], "id", "year", "time").rows()).select("term", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"))


@query(
    "did_twoway_cluster",
    f"""WITH {_SWEPT}, e AS (SELECT id, year, dd * (yy - beta * dd) AS u FROM s, b), i AS (SELECT sum(u) AS u FROM e GROUP BY id), t AS (SELECT sum(u) AS u FROM e GROUP BY year)
SELECT 'd' AS term, round(sqrt((SELECT sum(u * u) FROM i) + (SELECT sum(u * u) FROM t) - (SELECT sum(u * u) FROM e)) / (SELECT sdd FROM b), 6) AS se""",
)
def _(spark, sf):
    return result_frame(spark, fe_ols(panel_cy(spark, sf), "y", ["d"], "id", "year", "twoway").rows()).select("term", F.round("se", 6).alias("se"))


@query("did_robust", f"""WITH {_SWEPT} SELECT 'd' AS term, round(sqrt(sum(dd * dd * (yy - beta * dd) * (yy - beta * dd))) / max(sdd), 6) AS se, round(1 - sum((yy - beta * dd) * (yy - beta * dd)) / sum(yy * yy), 6) AS r2_within FROM s, b""")
def _(spark, sf):
    return result_frame(spark, fe_ols(panel_cy(spark, sf), "y", ["d"], "id", "year", "robust").rows()).select("term", F.round("se", 6).alias("se"), F.round("r2_within", 6).alias("r2_within"))


#: Rows of both outcomes, told apart by grp.
_TWO = f"""{PANEL}, two AS (SELECT 'y' AS grp, id, year, y, d FROM panel UNION ALL SELECT 'x', id, year, x, d FROM panel), {fe_sql("two", ["d"])}"""


@query("did_table", f"WITH {_TWO} SELECT grp AS outcome, term, coef, se, nobs, 'ok' AS status, significant FROM ({coefficients('f', ['d'])})")
def _(spark, sf):
    return E.did_table(panel_cy(spark, sf), ["y", "x"], "id", "year", "d").select("outcome", "term", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"), "nobs", "status", "significant")


_KS = [k for k in range(-3, 4) if k != -1]


@query(
    "event_study_coefs",
    f"""WITH {PANEL}, es AS (SELECT 'a' AS grp, id, year, y, g, k FROM panel WHERE k IS NULL OR k BETWEEN -3 AND 3), {fe_sql("es", [f"coalesce(g > 0 AND k = {k}, false)" for k in _KS])}
SELECT {_KS}[CAST(b.i AS INT)] AS k, round(beta, 6) AS coef, round(sqrt(v), 6) AS se, round(beta - 1.96 * sqrt(v), 5) AS lo, round(beta + 1.96 * sqrt(v), 5) AS hi, 'ok' AS status FROM f_b b JOIN f_v v ON v.i = b.i AND v.j = b.i UNION ALL SELECT -1, 0, 0, 0, 0, 'reference'""",
)
def _(spark, sf):
    p = panel_cy(spark, sf).withColumn("t", (F.col("g") > 0).cast("int")).where("k is null or k between -3 and 3")
    return E.event_study(p, "y", "id", "year", "k", "t", -3, 3).select("k", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"), F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), "status")


@query(
    "event_study_moments",
    f"WITH {PANEL} SELECT k, count(*) AS n, round(avg(y), 5) AS mean_y, round(stddev_samp(y), 5) AS sd_y FROM panel WHERE k BETWEEN -3 AND 3 GROUP BY 1",
)
def _(spark, sf):
    return panel_cy(spark, sf).where("k between -3 and 3").groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("y"), 5).alias("mean_y"), F.round(F.stddev_samp("y"), 5).alias("sd_y"))


_TRIPLE = ["d", "post_x_z", "treat_x_z"]


@query(
    "triple_did",
    f"""WITH {PANEL}, tr AS (SELECT 'a' AS grp, id, year, y, d, CAST(year >= 1998 AND segment = 'BUILDING' AS INT) AS post_x_z, d * CAST(segment = 'BUILDING' AS INT) AS treat_x_z FROM panel), {fe_sql("tr", _TRIPLE)}
SELECT term, coef, se, nobs, n_entities FROM ({coefficients("f", _TRIPLE)})""",
)
def _(spark, sf):
    p = panel_cy(spark, sf).withColumn("post", (F.col("year") >= 1998).cast("int")).withColumn("z", (F.col("segment") == "BUILDING").cast("int"))
    return result_frame(spark, E.triple_did(p, "y", "z", "id", "year", "post", "d").rows()).select("term", (F.round("coef", 6) + 0.0).alias("coef"), F.round("se", 6).alias("se"), "nobs", "n_entities")


_BINS = (2, 3, 5)


def _bin(z: str, n: int) -> str:
    """Right-closed bins between the distinct cut points; the lowest is in the first."""
    e = f"e_{z}_{n}"
    return f"CASE WHEN len(list_distinct({e})) > 1 AND {z} BETWEEN {e}[1] AND {e}[{n + 1}] THEN CAST(greatest(len([c for c in list_distinct({e}) if c < {z}]) - 1, 0) AS INT) END AS {z}_q{n}"


_SPLITS = f"""{PANEL}, zs AS (SELECT p.*, b.spend AS z_size, b.n_orders / nullif(b.spend, 0) AS z_deal FROM panel p LEFT JOIN panel b ON b.id = p.id AND b.k = -1),
cuts AS (SELECT {", ".join(f"quantile_cont({z}, {[i / n for i in range(n + 1)]}) AS e_{z}_{n}" for z in ("z_size", "z_deal") for n in _BINS)} FROM zs WHERE g > 0),
splits AS (SELECT zs.*, {", ".join(_bin(z, n) for z in ("z_size", "z_deal") for n in _BINS)} FROM zs, cuts)"""
_SPECS = [f"{z}{q}" for z in ("z_size", "z_deal") for q in ("", "_q2", "_q3", "_q5")]


def _splits(spark, sf):
    p = panel_cy(spark, sf).withColumn("t", (F.col("g") > 0).cast("int"))
    return H.all_z(p, "id", "k", "t", "spend", "n_orders", "spend", bins=_BINS)


@query(
    "heterogeneity_specs",
    f"""WITH {_SPLITS}, hs AS ({" UNION ALL ".join(f"SELECT '{z}|{y}' AS grp, id, year, {y} AS y, d, CAST(year >= 1998 AS INT) * coalesce({z}, 0) AS post_x_z, d * coalesce({z}, 0) AS treat_x_z FROM splits" for z in _SPECS for y in ("y", "x"))}), {fe_sql("hs", _TRIPLE)}
SELECT split_part(grp, '|', 1) AS spec, split_part(grp, '|', 2) AS outcome, term, coef, round(se, 4) AS se, nobs FROM ({coefficients("f", _TRIPLE, 4)})""",
)
def _(spark, sf):
    p = _splits(spark, sf).withColumn("post", (F.col("year") >= 1998).cast("int"))
    got = E.heterogeneity_specs(p, ["y", "x"], {z: z for z in _SPECS}, "id", "year", post="post", treat="d")
    return got.where("coef is not null").select("spec", "outcome", "term", (F.round("coef", 4) + 0.0).alias("coef"), F.round("se", 4).alias("se"), "nobs")


@query("all_baseline_splits", f"WITH {_SPLITS} SELECT id, year, z_size, round(z_deal, 12) AS z_deal, {', '.join(f'{z}_q{n}' for z in ('z_size', 'z_deal') for n in _BINS)} FROM splits")
def _(spark, sf):
    return _splits(spark, sf).select("id", "year", "z_size", F.round("z_deal", 12).alias("z_deal"), *[f"{z}_q{n}" for z in ("z_size", "z_deal") for n in _BINS])


_CELLS = [(g, k) for g in range(FIRST, LAST + 1) for k in _KS if FIRST <= g + k <= LAST]


@query(
    "sun_abraham",
    f"""WITH {PANEL}, sa AS (SELECT 'a' AS grp, id, year, y, g FROM panel), {fe_sql("sa", [f"(g = {g} AND year = {g + k})" for g, k in _CELLS], twoway=True)},
sacells AS (SELECT {[g for g, _ in _CELLS]}[CAST(i AS INT)] AS g, {[k for _, k in _CELLS]}[CAST(i AS INT)] AS k, i, beta FROM f_b),
sizes AS (SELECT g, count(DISTINCT id) AS n FROM panel WHERE g > 0 GROUP BY 1),
e AS (SELECT ks.k, s.g, s.n, s.n / sum(s.n) OVER (PARTITION BY ks.k) AS w, sum(s.n) OVER (PARTITION BY ks.k) AS total, c.i, coalesce(c.beta, 0) AS b FROM sizes s CROSS JOIN (SELECT unnest({_KS}) AS k) ks LEFT JOIN sacells c ON c.g = s.g AND c.k = ks.k WHERE s.g + ks.k BETWEEN {FIRST} AND {LAST}),
v1 AS (SELECT a.k, sum(a.w * b.w * v.v) AS v FROM e a JOIN e b ON a.k = b.k JOIN f_v v ON v.i = a.i AND v.j = b.i GROUP BY 1),
v2 AS (SELECT k, (sum(w * b * b) - sum(w * b) * sum(w * b)) / greatest(1, max(total) - 1) AS v, sum(w * b) AS coef, count(*) AS n_cohorts FROM e GROUP BY 1)
SELECT k, round(coef, 5) AS coef, round(sqrt(greatest(0, v1.v + v2.v)), 5) AS se, CAST(n_cohorts AS INT) AS n_cohorts FROM v1 JOIN v2 USING (k) UNION ALL SELECT -1, 0, 0, 0""",
)
def _(spark, sf):
    return E.sun_abraham(panel_cy(spark, sf), "y", "id", "year", "g", -3, 3).select("k", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"), "n_cohorts")


_ATT = f"""{PANEL}, c AS (SELECT g, year AS t, sum(y) AS s, count(*) AS n FROM panel GROUP BY 1, 2),
w AS (SELECT g, t, t - g AS k, CASE WHEN t >= g THEN g - 1 ELSE t - 1 END AS b, s / n AS y1, n AS n1 FROM c WHERE g > 0),
a AS (SELECT w.*, y1 - p.s / p.n AS dt FROM w JOIN c p ON p.g = w.g AND p.t = w.b),
att AS (SELECT a.g, a.t, a.k, dt - ((SELECT sum(s) / sum(n) FROM c WHERE c.t = a.t AND (c.g = 0 OR c.g > greatest(a.t, a.b)) AND c.g <> a.g) - (SELECT sum(s) / sum(n) FROM c WHERE c.t = a.b AND (c.g = 0 OR c.g > greatest(a.t, a.b)) AND c.g <> a.g)) AS att,
  n1 AS n_treated, (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE c.t = a.t AND (c.g = 0 OR c.g > greatest(a.t, a.b)) AND c.g <> a.g) AS n_control FROM a)"""


@query("att_gt", f"WITH {_ATT} SELECT g, t, k, round(att, 5) AS att, n_treated, n_control FROM att")
def _(spark, sf):
    return E.att_gt(panel_cy(spark, sf), "y", "id", "year", "g").withColumn("att", F.round("att", 5))


@query(
    "att_dynamic",
    f"""WITH {_ATT}, z AS (SELECT g, count(DISTINCT id) AS w FROM panel WHERE g > 0 GROUP BY 1), d AS (SELECT k, sum(w * att) / sum(w) AS att, count(*) AS n_cohorts FROM att JOIN z USING (g) WHERE k BETWEEN -3 AND 3 GROUP BY 1)
SELECT k, round(att, 5) AS att, n_cohorts, round((SELECT avg(att) FROM d WHERE k >= 0), 5) AS overall FROM d""",
)
def _(spark, sf):
    p = panel_cy(spark, sf)
    got = E.att_dynamic(E.att_gt(p, "y", "id", "year", "g"), E.cohort_sizes(p, "id", "g"), -3, 3)
    return got.select("k", F.round("att", 5).alias("att"), "n_cohorts", F.round("overall", 5).alias("overall"))


@query("att_composition_ci")
def _(spark, sf):
    p = panel_cy(spark, sf)
    return E.composition_ci(E.att_gt(p, "y", "id", "year", "g"), E.cohort_sizes(p, "id", "g"), -3, 3)


@query("att_gt_doubly_robust")
def _(spark, sf):
    return E.att_gt_dr(panel_cy(spark, sf), "y", "id", "year", "g", ["x"])


#: What these queries are run with, in Spark and in SQL.
SETTINGS = Parameters(window=(-3, 2), min_cohort=30, before=2, after=3, lead=2)
_MIN_COHORT, _BEFORE, _AFTER = SETTINGS.min_cohort, SETTINGS.before, SETTINGS.after
# Strict roles, cohorts of enough units, windows, periods with a control, identified cells. With a 0/1 trait the logistic
# fit and the regression of a cell are saturated, so the doubly robust effect is a mean over the trait's values.
_ROLES = f"""{PANEL_ROLES}, rr AS (
  SELECT * FROM ({" UNION ALL ".join(f"SELECT '{r}' AS role, id AS e, year AS t, y, s, g_{r} AS g FROM panel_roles WHERE g = 0 OR g_{r} = g" for r in ROLES)})),
rbig AS (SELECT role, g FROM rr WHERE g > 0 GROUP BY ALL HAVING count(DISTINCT e) >= {_MIN_COHORT}),
rspan AS (SELECT role, min(g) - {_BEFORE} AS first, max(g) + {_AFTER} AS last FROM rbig GROUP BY 1),
rwin AS (SELECT rr.* FROM rr JOIN rspan USING (role) LEFT JOIN rbig b ON b.role = rr.role AND b.g = rr.g
  WHERE t BETWEEN first AND last AND (rr.g = 0 OR (b.g IS NOT NULL AND t - rr.g BETWEEN -{_BEFORE} AND {_AFTER}))),
rs AS (SELECT * FROM rwin WHERE (role, t) IN (SELECT role, t FROM rwin WHERE g = 0 OR g > t)),
rc AS (SELECT role, g, t, CASE WHEN t >= g THEN g - 1 ELSE t - 1 END AS b FROM rs WHERE g > 0 GROUP BY ALL),
rz AS (
  SELECT c.role, c.g, c.t, CAST(n.g = c.g AS INT) AS w, n.y - o.y AS dy, o.s
  FROM rc c JOIN rs n ON n.role = c.role AND n.t = c.t AND (n.g = c.g OR n.g = 0 OR n.g > greatest(c.t, c.b)) JOIN rs o ON o.role = n.role AND o.e = n.e AND o.t = c.b),
rv AS (SELECT role, g, t, s, count(*) FILTER (w = 1) AS n1, count(*) FILTER (w = 0) AS n0, avg(dy) FILTER (w = 1) AS m1, avg(dy) FILTER (w = 0) AS m0 FROM rz GROUP BY ALL),
ratt AS (
  SELECT role, g, t, t - g AS k, CAST(sum(n1) AS BIGINT) AS n_treated, CAST(sum(n0) AS BIGINT) AS n_control, count(*) = 2 AND min(n1) > 0 AND min(n0) > 0 AS saturated,
         sum(n1 * (m1 - m0)) / sum(n1) AS robust, sum(n1 * m1) / sum(n1) - sum(n0 * m0) / sum(n0) AS plain FROM rv GROUP BY ALL HAVING sum(n1) > 0 AND sum(n0) > 0)"""


def _by_role(spark, sf, x):
    return G.role_sample(panel_roles(spark, sf), "y", "id", "year", {r: f"g_{r}" for r in ROLES}, "g", x, True, parameters=SETTINGS)


@query("att_gt_by_role", f"WITH {_ROLES} SELECT role, g, t, k, round(CASE WHEN saturated THEN robust ELSE plain END, 5) + 0.0 AS att, n_treated, n_control, CASE WHEN saturated THEN 'doubly robust' ELSE 'difference of means' END AS method FROM ratt")
def _(spark, sf):
    return G.att_gt_by_role(_by_role(spark, sf, ["s"]), ["s"]).withColumn("att", F.round("att", 5) + 0.0)


@query("att_overall_by_role", f"WITH {_ROLES} SELECT role, round(coalesce(avg(plain) FILTER (t >= g), avg(plain)), 5) + 0.0 AS att, count(*) AS n_cells FROM ratt GROUP BY 1")
def _(spark, sf):
    return G.att_overall(G.att_gt_by_role(_by_role(spark, sf, []))).withColumn("att", F.round("att", 5) + 0.0)


@query(
    "att_dynamic_by_role",
    f"WITH {_ROLES}, ru AS (SELECT role, g, count(DISTINCT e) AS u FROM rs WHERE g > 0 GROUP BY ALL) SELECT role, k, round(sum(u * plain) / sum(u), 5) + 0.0 AS att, count(*) AS n_cohorts FROM ratt JOIN ru USING (role, g) WHERE k BETWEEN -2 AND 3 GROUP BY 1, 2",
)
def _(spark, sf):
    sample = _by_role(spark, sf, [])
    return G.att_dynamic_by_role(G.att_gt_by_role(sample), sample, -2, 3).withColumn("att", F.round("att", 5) + 0.0)


_TAU = f"""{PANEL}, un AS (SELECT 'a' AS grp, id, year, y FROM panel WHERE d = 0), {fe_sql("un", [])},
al AS (SELECT p.id, avg(p.y - t.effect) AS a FROM panel p JOIN f_t t USING (year) WHERE p.d = 0 GROUP BY 1),
tau AS (SELECT p.id, p.year, p.k, p.d, p.y - t.effect - coalesce(al.a, 0) AS tau FROM panel p JOIN f_t t USING (year) LEFT JOIN al USING (id))"""


@query("bjs_att_by_k", f"WITH {_TAU} SELECT k, CAST(d AS INT) AS treated, round(avg(tau), 6) + 0.0 AS att, count(*) AS n FROM tau WHERE k IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return E.bjs_att(E.bjs_effects(panel_cy(spark, sf), "y", "id", "year", "d"), "d").withColumn("att", F.round("att", 6) + 0.0)


@query("bjs_wild_band")
def _(spark, sf):
    return X.wild_band(E.bjs_effects(panel_cy(spark, sf), "y", "id", "year", "d"), "id", "d", draws=500)


@query("bjs_refit_band")
def _(spark, sf):
    return X.refit_band(panel_cy(spark, sf), "y", "id", "year", "d", draws=500)


@query("synthetic_control")
def _(spark, sf):
    return E.scm_att(E.synthetic_control(panel_cy(spark, sf), "y", "id", "year", "g", None, 3, 2, lo=-3, hi=3), "id", 3)


@query("synthetic_control_band")
def _(spark, sf):
    return X.scm_band(E.synthetic_control(panel_cy(spark, sf), "y", "id", "year", "g", None, 3, 2, lo=-3, hi=3), "id", 500, hi=3)


@query("dml_ate")
def _(spark, sf):
    p = panel_cy(spark, sf).withColumn("e", F.when(F.col("g") > 0, F.col("g")).otherwise(1998)).withColumn("t", (F.col("g") > 0).cast("int"))
    x = E.event_cross_section(p.withColumn("kk", F.col("year") - F.col("e")), "y", ["x", "spend"], "id", "kk", "t", (1, 3))
    return E.dml_cate(x, "y_post", "t", ["x", "spend"], "id", trees=100)[0]


@query("significant_outcomes", f"WITH {_TWO} SELECT grp AS outcome FROM ({coefficients('f', ['d'])}) WHERE significant")
def _(spark, sf):
    names = E.significant_outcomes(E.did_table(panel_cy(spark, sf), ["y", "x"], "id", "year", "d"), "d")
    return spark.createDataFrame([(n,) for n in names], "outcome string")


@query(
    "placebo_lead",
    f"""WITH {PANEL} SELECT id, year, CASE WHEN g > 0 THEN g - 2 ELSE 0 END AS g_placebo, CASE WHEN g > 0 THEN year - g + 2 END AS k_placebo, CASE WHEN g > 0 AND year >= g - 2 THEN 1 ELSE 0 END AS d_placebo FROM panel WHERE g = 0 OR year < g""",
)
def _(spark, sf):
    return X.placebo(panel_cy(spark, sf), "id", "year", "g", "lead", 2).select("id", "year", "g_placebo", "k_placebo", "d_placebo")


def _hash(parts: str, seed: int = 42) -> str:
    """hashed() in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 15) AS BIGINT)"


_PERMUTED = f"""u AS (SELECT DISTINCT id, g FROM panel WHERE g > 0), o1 AS (SELECT id, row_number() OVER (ORDER BY {_hash("id")}, id) AS r FROM u), o2 AS (SELECT g, row_number() OVER (ORDER BY {_hash("id", 43)}, id) AS r FROM u),
permuted AS (SELECT p.*, coalesce(o2.g, 0) AS g_placebo FROM panel p LEFT JOIN o1 USING (id) LEFT JOIN o2 USING (r) WHERE p.g = 0 OR p.year < p.g)"""


@query("placebo_permute", f"WITH {PANEL}, {_PERMUTED} SELECT id, year, g_placebo, CASE WHEN g_placebo > 0 THEN year - g_placebo END AS k_placebo, CASE WHEN g_placebo > 0 AND year >= g_placebo THEN 1 ELSE 0 END AS d_placebo FROM permuted")
def _(spark, sf):
    return X.placebo(panel_cy(spark, sf), "id", "year", "g", "permute").select("id", "year", "g_placebo", "k_placebo", "d_placebo")


@query(
    "placebo_suite",
    f"""WITH {PANEL}, {_PERMUTED}, both_kinds AS (SELECT 'permute' AS kind, id, year, y, x, g_placebo AS gp FROM permuted UNION ALL SELECT 'lead', id, year, y, x, CASE WHEN g > 0 THEN g - 1 ELSE 0 END FROM panel WHERE g = 0 OR year < g),
pl AS (SELECT kind || '|y' AS grp, id, year, y, CAST(gp > 0 AND year >= gp AS INT) AS d FROM both_kinds UNION ALL SELECT kind || '|x', id, year, x, CAST(gp > 0 AND year >= gp AS INT) FROM both_kinds), {fe_sql("pl", ["d"])}
SELECT split_part(grp, '|', 1) AS kind, split_part(grp, '|', 2) AS outcome, coef, se, nobs FROM ({coefficients("f", ["d"])})""",
)
def _(spark, sf):
    return X.placebo_suite(panel_cy(spark, sf), ["y", "x"], "id", "year", "g", 1).select("kind", "outcome", (F.round("coef", 6) + 0.0).alias("coef"), F.round("se", 6).alias("se"), "nobs")


_PL_LEAD, (_PL_LO, _PL_HI) = SETTINGS.lead, SETTINGS.window
_PL_KS = [k for k in range(_PL_LO, _PL_HI + 1) if k != -1]
_PL_GS = range(FIRST - _PL_LEAD, LAST + 1)
_PL_CELLS = [(g, k) for g in _PL_GS for k in _PL_KS if FIRST <= g + k <= LAST]


def _placebo_rows(role: str) -> str:
    """Rows of a role before its real treatment, with both kinds of false years."""
    units = f"(SELECT DISTINCT id, g_{role} AS gr FROM panel_roles WHERE g_{role} > 0)"
    first, second = (f"(SELECT *, row_number() OVER (ORDER BY {_hash('id', s)}, id) AS r FROM {units})" for s in (42, 43))
    rows = f"panel_roles p WHERE (p.g_{role} > 0 OR p.g = 0) AND (p.g_{role} = 0 OR p.year < p.g_{role})"
    swap = f"(SELECT a.id, b.gr FROM {first} a JOIN {second} b USING (r))"
    return (
        f"SELECT '{role}|lead' AS tag, p.id, p.year, p.y, p.x, CASE WHEN p.g_{role} > 0 THEN p.g_{role} - {_PL_LEAD} ELSE 0 END AS gp FROM {rows} "
        f"UNION ALL SELECT '{role}|permute', q.id, q.year, q.y, q.x, coalesce(s.gr, 0) FROM (SELECT p.* FROM {rows}) q LEFT JOIN {swap} s ON s.id = q.id"
    )


_STUDIES = f"""{PANEL_ROLES},
real AS ({" UNION ALL ".join(f"SELECT '{r}|{y}' AS grp, id, year, {y} AS y, CAST(g_{r} > 0 AND year >= g_{r} AS INT) AS d FROM panel_roles WHERE g_{r} > 0 OR g = 0" for r in ROLES for y in ("y", "x"))}), {fe_sql("real", ["d"], "r")},
gate AS (SELECT grp FROM ({coefficients("r", ["d"])}) WHERE significant),
pw AS (SELECT *, CASE WHEN gp > 0 THEN year - gp END AS k FROM ({" UNION ALL ".join(_placebo_rows(r) for r in ROLES)})),
po AS (SELECT tag || '|y' AS grp, id, year, y, gp, k FROM pw UNION ALL SELECT tag || '|x', id, year, x, gp, k FROM pw),
pp AS (SELECT *, CAST(coalesce(k >= 0, false) AS INT) AS d, k IS NULL OR k BETWEEN {_PL_LO} AND CASE WHEN grp LIKE '%lead%' THEN {_PL_LEAD - 1} ELSE {_PL_HI} END AS near FROM po
  WHERE split_part(grp, '|', 1) || '|' || split_part(grp, '|', 3) IN (SELECT grp FROM gate)),
pn AS (SELECT * FROM pp WHERE near), p2 AS (SELECT * FROM pn QUALIFY count(*) OVER (PARTITION BY grp, id) >= 2), pu AS (SELECT * FROM pn WHERE d = 0),
{fe_sql("pp", ["d"], "fd")}, {fe_sql("pn", [f"coalesce(k = {k}, false)" for k in _PL_KS], "fe")},
{fe_sql("p2", [f"(gp = {g} AND year = {g + k})" for g, k in _PL_CELLS], "fs", twoway=True)}, {fe_sql("pu", [], "fi")},
pz AS (SELECT grp, gp AS g, count(DISTINCT id) AS n FROM p2 WHERE gp > 0 GROUP BY ALL), pspan AS (SELECT grp, min(year) AS first, max(year) AS last FROM p2 GROUP BY 1),
pc AS (SELECT grp, {[g for g, _ in _PL_CELLS]}[CAST(i AS INT)] AS g, {[k for _, k in _PL_CELLS]}[CAST(i AS INT)] AS k, i, beta FROM fs_b),
pe AS (SELECT z.grp, ks.k, z.g, z.n / sum(z.n) OVER w AS w, sum(z.n) OVER w AS total, c.i, coalesce(c.beta, 0) AS b FROM pz z CROSS JOIN (SELECT unnest({_PL_KS}) AS k) ks JOIN pspan USING (grp)
  LEFT JOIN pc c ON c.grp = z.grp AND c.g = z.g AND c.k = ks.k WHERE z.g + ks.k BETWEEN first AND last WINDOW w AS (PARTITION BY z.grp, ks.k)),
pv AS (SELECT a.grp, a.k, sum(a.w * b.w * v.v) AS v FROM pe a JOIN pe b ON a.grp = b.grp AND a.k = b.k JOIN fs_v v ON v.grp = a.grp AND v.i = a.i AND v.j = b.i GROUP BY ALL),
pq AS (SELECT grp, k, (sum(w * b * b) - sum(w * b) * sum(w * b)) / greatest(1, max(total) - 1) AS v, sum(w * b) AS coef, count(*) AS n FROM pe GROUP BY ALL),
pal AS (SELECT u.grp, u.id, avg(u.y - t.effect) AS a FROM pu u JOIN fi_t t USING (grp, year) GROUP BY ALL),
studies AS (
  SELECT b.grp, 'did' AS method, CAST(NULL AS INT) AS k, beta AS coef, sqrt(v) AS se, nobs AS n FROM fd_b b JOIN fd_v v ON v.grp = b.grp AND v.i = b.i AND v.j = b.i JOIN fd_n n ON n.grp = b.grp
  UNION ALL SELECT b.grp, 'event_study', {_PL_KS}[CAST(b.i AS INT)], beta, sqrt(v), nobs FROM fe_b b JOIN fe_v v ON v.grp = b.grp AND v.i = b.i AND v.j = b.i JOIN fe_n n ON n.grp = b.grp
  UNION ALL SELECT grp, 'sun_abraham', k, coef, sqrt(greatest(0, pv.v + pq.v)), n FROM pq JOIN pv USING (grp, k)
  UNION ALL SELECT p.grp, 'imputation', p.k, avg(p.y - t.effect - coalesce(a.a, 0)), NULL, count(*) FROM pn p JOIN fi_t t USING (grp, year) LEFT JOIN pal a USING (grp, id) WHERE p.d = 1 GROUP BY ALL)"""


@query(
    "placebo_studies",
    f"WITH {_STUDIES} SELECT split_part(grp, '|', 1) AS role, split_part(grp, '|', 2) AS kind, split_part(grp, '|', 3) AS outcome, method, k, round(coef, 5) + 0.0 AS coef, round(se, 5) AS se, n FROM studies",
)
def _(spark, sf):
    got = P.placebo_studies(panel_roles(spark, sf), ["y", "x"], "id", "year", {r: f"g_{r}" for r in ROLES}, "g", parameters=SETTINGS)
    return got.withColumns({"coef": F.round("coef", 5) + 0.0, "se": F.round("se", 5)})


@query("sample_units", f"WITH {PANEL}, e AS (SELECT DISTINCT id, CAST(g > 0 AS INT) AS t FROM panel), s AS (SELECT id, t FROM e QUALIFY row_number() OVER (PARTITION BY t ORDER BY {_hash('id')}, id) <= CASE WHEN t = 1 THEN 50 ELSE 100 END) SELECT id, year, t FROM panel JOIN s USING (id)")
def _(spark, sf):
    p = panel_cy(spark, sf).withColumn("t", (F.col("g") > 0).cast("int"))
    return X.sample_units(p, "id", "t", 50, 100).select("id", "year", "t")


def _pool(spark, sf, at=1998):
    return panel_cy(spark, sf).where((F.col("year") == at - 1) & F.col("g").isin(0, at)).withColumn("t", (F.col("g") > 0).cast("int"))


def _nearest(name: str, at: int, used: str = "") -> str:
    """CTEs with the nearest control of each unit treated in that year, by the block's covariance of the year before."""
    return f"""{name}p AS (SELECT * FROM panel WHERE year = {at - 1} AND g IN (0, {at}){f" AND id NOT IN (SELECT control FROM {used})" if used else ""}),
{name}v AS (SELECT segment, var_samp(x) + 1e-8 AS a, covar_samp(x, spend) AS b, var_samp(spend) + 1e-8 AS c FROM {name}p GROUP BY 1),
{name}j AS (SELECT t.id, u.id AS control, t.segment, sqrt(greatest((c * (t.x - u.x) * (t.x - u.x) - 2 * b * (t.x - u.x) * (t.spend - u.spend) + a * (t.spend - u.spend) * (t.spend - u.spend)) / (a * c - b * b), 0)) AS dist
  FROM {name}p t JOIN {name}p u ON t.segment = u.segment AND t.g > 0 AND u.g = 0 JOIN {name}v v ON v.segment = t.segment),
{name} AS MATERIALIZED (SELECT CAST({at} AS BIGINT) AS cohort, id, control, segment, round(dist, 4) AS distance FROM {name}j QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, control) = 1)"""


@query("match_mahalanobis", f"WITH {PANEL}, {_nearest('m', 1998)} SELECT id, control, segment, distance FROM m")
def _(spark, sf):
    return M.match_mahalanobis(_pool(spark, sf), "id", "t", "segment", "x", "spend").select("id", "control", "segment", F.round("distance", 4).alias("distance"))


def _all_cohorts() -> str:
    out, used = [], ""
    for at in range(FIRST, LAST + 1):
        out.append(_nearest(f"m{at}", at, used))
        before = f"SELECT * FROM {used} UNION ALL " if used else ""
        used = f"used{at}"
        out.append(f"{used} AS MATERIALIZED ({before}SELECT * FROM m{at})")
    return ",\n".join(out)


@query("match_cohorts", f"WITH {PANEL}, {_all_cohorts()} SELECT * FROM used{LAST}")
def _(spark, sf):
    return M.match_cohorts(panel_cy(spark, sf), "id", "year", "g", "segment", "x", "spend").select("cohort", "id", "control", "segment", F.round("distance", 4).alias("distance"))


@query(
    "match_stack_cohorts",
    f"""WITH {PANEL}, {_all_cohorts()}, ids AS (SELECT cohort, id FROM used{LAST} UNION SELECT cohort, control FROM used{LAST}),
s AS (SELECT p.id, p.year, cohort, p.year - cohort AS event_time, CAST(p.g = cohort AS INT) AS treated FROM panel p JOIN ids USING (id) WHERE p.year - cohort BETWEEN -2 AND 2 QUALIFY row_number() OVER (PARTITION BY p.id, p.year ORDER BY cohort, CAST(p.g = cohort AS INT) DESC) = 1)
SELECT *, treated * CAST(event_time >= 0 AS INT) AS post_treated FROM s""",
)
def _(spark, sf):
    p = stage(panel_cy(spark, sf), "panel")
    pairs = M.match_cohorts(p, "id", "year", "g", "segment", "x", "spend")
    return M.stack_cohorts(p, pairs, "id", "year", "g", -2, 2).select("id", "year", "cohort", "event_time", "treated", "post_treated")


_POOL = f"""{PANEL}, pool0 AS (SELECT *, CAST(g > 0 AS INT) AS t FROM panel WHERE year = 1997 AND g IN (0, 1998)),
pool AS (SELECT *, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS sx, (spend - avg(spend) OVER ()) / stddev_samp(spend) OVER () AS ss FROM pool0)"""
_SEGMENTS = [f"segment = '{s}'" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]


@query("propensity_scores", f"WITH {_POOL}, {logit_sql('pool', ['sx', 'ss', *_SEGMENTS])} SELECT id, t, round(pscore, 4) AS pscore FROM q_score JOIN pool USING (id)")
def _(spark, sf):
    return M.propensity(_pool(spark, sf), "t", ["x", "spend"], ["segment"], standardise=True).select("id", "t", F.round("pscore", 4).alias("pscore"))


# The walk as it is told: treated units in order of ids, each takes the nearest controls that fewer than 2 before it took.
@query(
    "match_ps_greedy",
    f"""WITH RECURSIVE {_POOL}, {logit_sql('pool', ['sx', 'ss'])},
sp AS (SELECT id, t, segment, x, pscore FROM pool JOIN q_score USING (id)),
cand AS MATERIALIZED (
  SELECT a.id AS tid, b.id AS cid, a.segment, abs(a.pscore - b.pscore) AS dist, dense_rank() OVER (ORDER BY a.id) AS nth
  FROM sp a JOIN sp b ON a.segment = b.segment AND a.t = 1 AND b.t = 0 AND abs(a.pscore - b.pscore) <= 0.05 AND abs(a.x - b.x) <= 2),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS picks
  UNION ALL
  SELECT i + 1, list_concat(any_value(used), coalesce(list(cid ORDER BY dist, cid)[1:3], [])), coalesce(list(cid ORDER BY dist, cid)[1:3], [])
  FROM (SELECT w.i, w.used, c.cid, c.dist FROM walk w JOIN cand c ON c.nth = w.i + 1) s WHERE len(list_filter(used, lambda u: u = cid)) < 2 GROUP BY i),
picked AS (SELECT i AS nth, unnest(picks) AS cid, generate_subscripts(picks, 1) AS control_rank FROM walk)
SELECT tid, cid, segment, CAST(control_rank AS INT) AS control_rank, round(dist, 4) AS dist FROM picked JOIN cand USING (nth, cid)""",
)
def _(spark, sf):
    pool = stage(_pool(spark, sf), "pool")  # the fit reads it many times
    s = M.propensity(pool, "t", ["x", "spend"], standardise=True).where("pscore is not null")
    side = lambda v: s.where(F.col("t") == v).select("id", "segment", "pscore", "x")
    return match_scores(side(1), side(0), ["segment"], "pscore", 0.05, [("x", 2)], 3, 2).withColumn("dist", F.round("dist", 4))


@query(
    "match_euclid",
    f"""WITH {PANEL}, p AS (SELECT *, CASE WHEN g > 0 THEN 1 ELSE 0 END AS t FROM panel WHERE year = 1997 AND g IN (0, 1998)), s AS (SELECT stddev_pop(x) AS sx, stddev_pop(spend) AS ss FROM p),
j AS (SELECT t.id AS tid, u.id AS cid, sqrt(pow((t.x - u.x) / sx, 2) + pow((t.spend - u.spend) / ss, 2)) AS dist FROM p t JOIN p u ON t.segment = u.segment AND t.t = 1 AND u.t = 0, s)
SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY dist, cid) AS control_rank, round(dist, 4) AS dist FROM j QUALIFY control_rank <= 3""",
)
def _(spark, sf):
    p = _pool(spark, sf)
    side = lambda v: p.where(F.col("t") == v).select("id", "segment", "x", "spend")
    return M.match_euclid(side(1), side(0), ["segment"], ["x", "spend"], n=3).select("tid", F.col("control_rank").cast("long").alias("control_rank"), F.round("dist", 4).alias("dist"))


@query("attach_control_firm", f"WITH {PANEL}, e AS (SELECT DISTINCT id, 1998 AS ey FROM panel WHERE g = 0) SELECT e.id, ey, coalesce(CASE WHEN a.n_orders > 0 THEN a.segment END, CASE WHEN b.n_orders > 0 THEN b.segment END) AS control_firm FROM e LEFT JOIN panel a ON a.id = e.id AND a.year = ey LEFT JOIN panel b ON b.id = e.id AND b.year = ey - 1")
def _(spark, sf):
    p = panel_cy(spark, sf)
    e = p.where("g = 0").select("id", F.lit(1998).cast("long").alias("ey")).distinct()
    return M.attach_control_firm(e, p.where("n_orders > 0"), "id", "ey", "year", "segment")
