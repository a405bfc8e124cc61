"""Queries on panel building, linking, accounting and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..functions.nulls import assert_unique, coerce_ids, null_out_negatives
from ..operators import diagnostics as Q
from ..operators import hetero as H
from ..operators import panels as P
from ..operators import windows as W
from ..operators.accounting import winsorize
from ..operators.deals import deal_roles
from ..operators.joins import asof_override, interval_join, nearest_event, two_sided_link
from .domain import BIG, DOCS, FIRST, MOVES, PANEL, docs, moves_and_rows, panel_cy, table
from .registry import query


def r(c, n=5):
    return F.round(c, n).alias(c)


@query("row_lag", f"WITH {PANEL} SELECT id, year, lag(n_orders) OVER (PARTITION BY id ORDER BY year) AS n_orders_lag FROM panel WHERE n_orders > 0")
def _(spark, sf):
    return W.row_lag(panel_cy(spark, sf).where("n_orders > 0"), "id", "year", ["n_orders"]).select("id", "year", "n_orders_lag")


@query("gap_lag", f"WITH {PANEL}, x AS (SELECT * FROM panel WHERE n_orders > 0) SELECT x.id, x.year, p.n_orders AS n_orders_lag FROM x LEFT JOIN x p ON p.id = x.id AND p.year = x.year - 1")
def _(spark, sf):
    return W.row_lag(panel_cy(spark, sf).where("n_orders > 0"), "id", "year", ["n_orders"], gap_aware=True).select("id", "year", "n_orders_lag")


@query("rolling_std5", f"WITH {PANEL} SELECT id, year, round(CASE WHEN count(x) OVER w = 5 THEN stddev_samp(x) OVER w END, 5) AS sd5 FROM panel WINDOW w AS (PARTITION BY id ORDER BY year ROWS 4 PRECEDING)")
def _(spark, sf):
    return W.rolling_std(panel_cy(spark, sf), "id", "year", "x", "sd5").select("id", "year", r("sd5"))


@query("cumulative_orders", f"WITH {PANEL} SELECT id, year, CAST(sum(n_orders) OVER (PARTITION BY id ORDER BY year) AS BIGINT) AS cum FROM panel")
def _(spark, sf):
    return W.cumulative(panel_cy(spark, sf), "id", "year", {"cum": "n_orders"}).select("id", "year", "cum")


@query("forward_fill", f"WITH {PANEL} SELECT id, year, last_value(CASE WHEN n_orders > 0 THEN n_orders END IGNORE NULLS) OVER (PARTITION BY id ORDER BY year ROWS UNBOUNDED PRECEDING) AS last_n FROM panel")
def _(spark, sf):
    return W.forward_fill(panel_cy(spark, sf).withColumn("v", F.when(F.col("n_orders") > 0, F.col("n_orders"))), "id", "year", "v", "last_n").select("id", "year", "last_n")


@query("average_rank_percent", f"WITH {PANEL} SELECT id, year, round((rank() OVER (PARTITION BY segment, year ORDER BY n_orders) + (count(*) OVER (PARTITION BY segment, year, n_orders) - 1) / 2.0) / count(*) OVER (PARTITION BY segment, year), 5) AS pct FROM panel")
def _(spark, sf):
    return panel_cy(spark, sf).select("id", "year", F.round(W.average_rank_percent("n_orders", "segment", "year"), 5).alias("pct"))


@query("distinct_in_group", "SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, n AS n_parts FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) g JOIN lineitem USING (l_orderkey) JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("n_parts", W.distinct_in_group("l_partkey", "l_orderkey").cast("long"))
    return x.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_parts")


@query("dedup_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def _(spark, sf):
    return W.first_by(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("top_n_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def _(spark, sf):
    return W.top_by(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("modal_firm", f"WITH {DOCS}, c AS (SELECT person, year, firm, count(*) AS n FROM docs GROUP BY 1, 2, 3) SELECT person, year, firm AS modal FROM c QUALIFY row_number() OVER (PARTITION BY person, year ORDER BY n DESC, firm) = 1")
def _(spark, sf):
    return W.modal_value(docs(spark, sf), ["person", "year"], "firm", "modal")


@query("unit_sample", f"WITH {PANEL}, s AS (SELECT DISTINCT id FROM panel ORDER BY CAST('0x' || substr(md5(id || '|42'), 1, 15) AS BIGINT), id LIMIT 100) SELECT id, year, n_orders FROM panel JOIN s USING (id)")
def _(spark, sf):
    return W.unit_sample(panel_cy(spark, sf), "id", 100).select("id", "year", "n_orders")


@query("entity_grid", "SELECT user_id, CAST(unnest(range(lo, hi + 1)) AS BIGINT) AS day FROM (SELECT user_id, min(day(ts)) AS lo, max(day(ts)) AS hi FROM events GROUP BY 1)")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.dayofmonth("ts").cast("long"))
    return W.grid(e, "user_id", F.min("day"), F.max("day"), "day")


_VALID = "v AS (SELECT s_suppkey, DATE '1995-01-01' + CAST(s_suppkey * 37 % 900 AS INT) AS lo, DATE '1995-01-01' + CAST(s_suppkey * 37 % 900 + 800 AS INT) AS hi, s_nationkey FROM supplier)"


def _valid(spark, sf):
    s = table(spark, sf, "supplier")
    at = (F.col("s_suppkey") * 37 % 900).cast("int")
    return s.select("s_suppkey", F.date_add(F.lit("1995-01-01").cast("date"), at).alias("lo"), F.date_add(F.lit("1995-01-01").cast("date"), at + 800).alias("hi"), "s_nationkey")


@query("interval_link", f"WITH {_VALID} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_nationkey FROM lineitem JOIN v ON l_suppkey = s_suppkey AND CAST(l_shipdate AS DATE) BETWEEN lo AND hi")
def _(spark, sf):
    f = table(spark, sf, "lineitem").withColumn("at", F.to_date("l_shipdate")).withColumnRenamed("l_suppkey", "s_suppkey")
    return interval_join(f, _valid(spark, sf), "s_suppkey", "at", "lo", "hi").select("l_orderkey", "l_linenumber", "l_partkey", F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")


@query(
    "two_sided_link",
    f"""WITH {_VALID}, d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS a, (l_suppkey + 7) % 10 + 1 AS b, CAST(l_shipdate AS DATE) AS dt FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, a, b, x.s_nationkey AS nation_a, y.s_nationkey AS nation_b FROM d JOIN v x ON a = x.s_suppkey AND dt BETWEEN x.lo AND x.hi
JOIN v y ON b = y.s_suppkey AND dt BETWEEN y.lo AND y.hi WHERE x.s_nationkey <> y.s_nationkey""",
)
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("a"), ((F.col("l_suppkey") + 7) % 10 + 1).alias("b"), F.to_date("l_shipdate").alias("at"))
    return two_sided_link(d, _valid(spark, sf).withColumnRenamed("s_nationkey", "nation"), "at", "a", "b", "s_suppkey", "nation", "lo", "hi").drop("at")


_EVENTS = f"ev AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS BIGINT) AS ey, o_orderkey AS ref, o_totalprice AS worth FROM orders WHERE o_totalprice > {BIG})"


def _events(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_totalprice") > BIG).select(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("long").alias("ey"), F.col("o_orderkey").alias("ref"), F.col("o_totalprice").alias("worth"))


@query(
    "nearest_event",
    f"""WITH {PANEL}, {_EVENTS}, a AS (SELECT p.id, p.year, max((ey, ref, worth)) AS m FROM panel p JOIN ev ON ev.id = p.id AND ey <= p.year GROUP BY 1, 2),
b AS (SELECT p.id, p.year, min((ey, ref, worth)) AS m FROM panel p JOIN ev ON ev.id = p.id AND ey >= p.year GROUP BY 1, 2),
j AS (SELECT p.id, p.year, CASE WHEN b.m IS NOT NULL AND (a.m IS NULL OR b.m[1] - p.year < p.year - a.m[1]) THEN b.m ELSE a.m END AS e FROM panel p LEFT JOIN a USING (id, year) LEFT JOIN b USING (id, year))
SELECT id, year, CASE WHEN abs(year - e[1]) <= 2 THEN year - e[1] END AS years_from_event, CASE WHEN abs(year - e[1]) <= 2 THEN e[2] END AS ref FROM j""",
)
def _(spark, sf):
    got = nearest_event(panel_cy(spark, sf).select("id", "year"), _events(spark, sf), "id", "year", "ey", ["ref", "worth"], 2)
    return got.select("id", "year", "years_from_event", "ref")


@query(
    "asof_override",
    f"""WITH {MOVES}, p AS (SELECT DISTINCT person, ship_year, 'none' AS cur FROM seg)
SELECT p.person, p.ship_year, coalesce((SELECT max((m.move_year, epoch_us(CAST(ship_date AS TIMESTAMP)), m.doc_id, m.line, m.part_id, m.to_state)) FROM moves m WHERE m.person = p.person AND m.move_year <= p.ship_year)[6], cur) AS state FROM p""",
)
def _(spark, sf):
    m, rows = moves_and_rows(spark, sf)
    p = rows.select("person", "ship_year").distinct().withColumn("cur", F.lit("none"))
    m = m.withColumn("__seq", F.struct("ship_date", "doc_id", "line", "part_id"))
    return asof_override(p, m, "person", "ship_year", "move_year", "to_state", "cur", "state").select("person", "ship_year", "state")


_STUDY = f"""{PANEL}, {_EVENTS}, roles AS (SELECT id AS permco, 'Acquiror' AS role, ref % 50 AS other, ey FROM ev UNION ALL SELECT ref % 50, 'Target', id, ey FROM ev)"""


@query("deal_roles_union", f"WITH {_STUDY} SELECT permco, role, other AS ma_other_party, ey FROM roles")
def _(spark, sf):
    e = _events(spark, sf).withColumn("t", F.col("ref") % 50)
    return deal_roles(e, "t", "id", ["ey"])


@query(
    "event_study_panel",
    f"""WITH {_STUDY}, k AS (SELECT id, year, role, years FROM (SELECT p.id, p.year, r.role, r.other, p.year - r.ey AS years,
  row_number() OVER (PARTITION BY p.id, p.year ORDER BY abs(p.year - r.ey), CASE WHEN r.ey <= p.year THEN 0 ELSE 1 END,
    CASE WHEN r.ey <= p.year THEN -(CASE r.role WHEN 'Target' THEN 1 ELSE 0 END) ELSE (CASE r.role WHEN 'Target' THEN 1 ELSE 0 END) END,
    CASE WHEN r.ey <= p.year THEN -r.other ELSE r.other END) AS rn FROM panel p JOIN roles r ON r.permco = p.id) WHERE rn = 1 AND abs(years) <= 2)
SELECT p.id, p.year, k.years AS years_from_event, coalesce(k.role, 'no_recent_MandA') AS role FROM panel p LEFT JOIN k USING (id, year)""",
)
def _(spark, sf):
    e = _events(spark, sf).withColumn("t", F.col("ref") % 50)
    roles = deal_roles(e, "t", "id", ["ey"]).withColumnsRenamed({"permco": "id", "ma_other_party": "other"})
    got = P.event_study_panel(panel_cy(spark, sf).select("id", "year"), roles, "id", "year", "ey", ["role", "other"], 2)
    return got.select("id", "year", "years_from_event", "role")


@query(
    "firm_year_panel",
    f"""WITH {MOVES}, sp AS (SELECT DISTINCT state AS firm, ship_year AS data_year FROM seg),
m AS (SELECT state AS firm, ship_year AS data_year, count(DISTINCT doc_id) AS n_docs, count(DISTINCT person) AS n_people, sum(value) AS v, avg(qty) AS q FROM seg GROUP BY 1, 2),
a AS (SELECT from_state AS firm, move_year AS data_year, count(DISTINCT person) AS n FROM moves GROUP BY 1, 2), b AS (SELECT to_state AS firm, move_year AS data_year, count(DISTINCT person) AS n FROM moves GROUP BY 1, 2)
SELECT firm, data_year, n_docs, n_people, round(v, 2) AS sum_value, round(q, 5) AS mean_qty, coalesce(a.n, 0) AS n_departures, coalesce(b.n, 0) AS n_arrivals
FROM sp JOIN m USING (firm, data_year) LEFT JOIN a USING (firm, data_year) LEFT JOIN b USING (firm, data_year)""",
)
def _(spark, sf):
    moved, rows = moves_and_rows(spark, sf, "value", "qty")
    s = rows.withColumnsRenamed({"state": "firm", "ship_year": "data_year"})
    m = P.metrics(s, ["firm", "data_year"], {"n_docs": "doc_id", "n_people": "person"}, ["value"], ["qty"])
    got = P.firm_year_panel(s.select("firm", "data_year").distinct(), [m, P.departures_arrivals(moved, "person")], ["n_docs", "n_people", "n_departures", "n_arrivals"])
    return got.select("firm", "data_year", "n_docs", "n_people", r("sum_value", 2), r("mean_qty"), "n_departures", "n_arrivals")


@query(
    "entity_year_panel",
    f"""WITH {DOCS}, m AS (SELECT person, year, count(DISTINCT doc_id) AS n_docs, sum(value) AS v FROM docs GROUP BY 1, 2),
c AS (SELECT person, year, firm, count(*) AS n FROM docs GROUP BY 1, 2, 3), f AS (SELECT person, year, firm FROM c QUALIFY row_number() OVER (PARTITION BY person, year ORDER BY n DESC, firm) = 1),
g AS (SELECT person, CAST(unnest(range(lo, hi + 1)) AS BIGINT) AS year FROM (SELECT person, min(year) AS lo, max(year) AS hi FROM m GROUP BY 1)),
x AS (SELECT firm AS fa, min(year) AS fy FROM docs WHERE value > 80000 GROUP BY 1), xt AS (SELECT firm AS fa, min(year) AS ft FROM docs WHERE qty >= 49 GROUP BY 1), xa AS (SELECT firm AS fa, min(year) AS fq FROM docs WHERE qty <= 2 GROUP BY 1),
p AS (SELECT g.person, g.year, coalesce(n_docs, 0) AS n_docs, coalesce(v, 0) AS v, last_value(firm IGNORE NULLS) OVER (PARTITION BY g.person ORDER BY g.year ROWS UNBOUNDED PRECEDING) AS fa
  FROM g LEFT JOIN m USING (person, year) LEFT JOIN f USING (person, year)),
q AS (SELECT p.*, CASE WHEN fy IS NOT NULL AND year >= fy THEN 1 ELSE 0 END AS exposed, CASE WHEN ft IS NOT NULL AND year >= ft THEN 1 ELSE 0 END AS exposed_target, CASE WHEN fq IS NOT NULL AND year >= fq THEN 1 ELSE 0 END AS exposed_acquiror FROM p LEFT JOIN x USING (fa) LEFT JOIN xt USING (fa) LEFT JOIN xa USING (fa))
SELECT person, year, n_docs, round(v, 2) AS sum_value, CAST(sum(n_docs) OVER (PARTITION BY person ORDER BY year) AS BIGINT) AS cum_n_docs, fa AS firm_assigned, exposed,
  min(CASE WHEN exposed = 1 THEN year END) OVER (PARTITION BY person) AS cohort, exposed_target, exposed_acquiror, min(CASE WHEN exposed_target = 1 THEN year END) OVER (PARTITION BY person) AS cohort_target, min(CASE WHEN exposed_acquiror = 1 THEN year END) OVER (PARTITION BY person) AS cohort_acquiror FROM q""",
)
def _(spark, sf):
    d = docs(spark, sf)
    since = lambda c: d.where(c).groupBy("firm").agg(F.min("year").alias("first_year"))
    got = P.entity_year_panel(d, "person", "year", "firm", {"n_docs": "doc_id"}, ["value"], [], None, since("value > 80000"), {"target": since("qty >= 49"), "acquiror": since("qty <= 2")})
    return got.select("person", "year", "n_docs", r("sum_value", 2), "cum_n_docs", "firm_assigned", *[f"{k}{n}" for n in ("", "_target", "_acquiror") for k in ("exposed", "cohort")])


@query("feasible_events", f"WITH {PANEL} SELECT DISTINCT id, g FROM panel WHERE g > 0 AND g - 2 >= 1995 AND g + 2 <= 2001")
def _(spark, sf):
    p = panel_cy(spark, sf)
    return P.feasible_events(p, p.where("g > 0").select("id", "g").distinct(), "id", "year", "g", -2, 2)


_BALANCED = f"""{PANEL}, e AS (SELECT DISTINCT id, g, 0 AS is_control_event FROM panel WHERE g > 0 UNION ALL SELECT id, 1998, 1 FROM (SELECT DISTINCT id, g FROM panel) WHERE g = 0),
b AS (SELECT e.*, CAST(unnest(range(-2, 3)) AS INT) AS k FROM e WHERE g - 2 >= 1995 AND g + 2 <= 2001)"""


def _balanced(spark, sf):
    p = panel_cy(spark, sf)
    ids = p.where(F.col("year") == FIRST).select("id", "g").distinct()  # the panel has every year of a customer
    return P.balanced_event_panel(p.drop("g", "k"), ids.where("g > 0"), "id", "year", "g", -2, 2, ["n_orders", "spend", "x"], ["n_orders", "spend"], ids.where("g = 0").select("id", F.lit(1998).cast("long").alias("g")))


@query("balanced_event_panel", f"WITH {_BALANCED} SELECT b.id, b.g, is_control_event, b.k, panel.n_orders FROM b JOIN panel ON panel.id = b.id AND panel.year = b.g + b.k")
def _(spark, sf):
    return _balanced(spark, sf).select("id", "g", "is_control_event", "k", "n_orders")


@query(
    "did_inputs",
    f"""WITH {PANEL}, z AS (SELECT *, CASE WHEN g > 0 AND abs(k) <= 2 THEN 'Acquiror' ELSE 'no_recent_MandA' END AS role, CASE WHEN g > 0 AND abs(k) <= 2 THEN k END AS kk FROM panel)
SELECT id, year, CAST(role <> 'no_recent_MandA' AS INT) AS treated, CAST(coalesce(kk, -1) >= 0 AS INT) AS post, CASE WHEN kk IS NOT NULL THEN year - kk ELSE 0 END AS g,
  round(ln(1 + spend), 5) AS log1p_spend, lag(n_orders) OVER (PARTITION BY id ORDER BY year) AS n_orders_lag FROM z WHERE kk BETWEEN -2 AND 2 OR role = 'no_recent_MandA'""",
)
def _(spark, sf):
    near = (F.col("g") > 0) & (F.abs("k") <= 2)
    p = panel_cy(spark, sf).withColumn("role", F.when(F.coalesce(near, F.lit(False)), "Acquiror").otherwise("no_recent_MandA")).withColumn("kk", F.when(near, F.col("k")))
    got = P.did_inputs(p, "id", "year", "kk", "role", -2, 2, ["spend"], ["n_orders"])
    return got.select("id", "year", "treated", "post", F.col("g").cast("long").alias("g"), r("log1p_spend"), "n_orders_lag")


@query("role_vs_control", f"WITH {_BALANCED} SELECT b.id || '|' || b.g || '|' || is_control_event AS inv_event_id, k, 1 - is_control_event AS treated, CAST(k >= 0 AS INT) AS post, (1 - is_control_event) * CAST(k >= 0 AS INT) AS post_treated FROM b WHERE k BETWEEN -1 AND 1")
def _(spark, sf):
    x = _balanced(spark, sf).withColumn("role", F.lit("Acquiror"))
    got = P.role_vs_control(x, "Acquiror", ["id", "g", "is_control_event"], "k", -1, 1)
    return got.select("inv_event_id", "k", "treated", "post", "post_treated")


@query("lag_controls", f"WITH {PANEL} SELECT id, year, lag(x) OVER w AS x_lag1, round(lag(y) OVER w, 5) AS y_lag1 FROM panel WINDOW w AS (PARTITION BY id ORDER BY year)")
def _(spark, sf):
    p = panel_cy(spark, sf)
    got = P.attach_controls(p.select("id", "year"), P.lag_controls(p, "id", "year", ["x", "y"]), "id", "year")
    return got.select("id", "year", "x_lag1", r("y_lag1"))


@query("panel_dedupe", f"WITH {DOCS} SELECT person, year, doc_id, line, part_id FROM docs QUALIFY row_number() OVER (PARTITION BY person, year ORDER BY doc_id, line, part_id, class) = 1")
def _(spark, sf):
    return P.panel_dedupe(docs(spark, sf), "person", "year", ["doc_id", "line", "part_id", "class"]).select("person", "year", "doc_id", "line", "part_id")


@query("union_missing", "SELECT id, o_year, value, kind FROM (SELECT o_custkey AS id, year(o_orderdate) AS o_year, o_totalprice AS value, 'order' AS kind FROM orders UNION ALL SELECT user_id, NULL, value, 'event' FROM events)")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("o_year"), F.col("o_totalprice").alias("value"), F.lit("order").alias("kind"))
    b = table(spark, sf, "events").select(F.col("user_id").alias("id"), "value", F.lit("event").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query("unpivot_metrics", f"WITH {PANEL} SELECT id, year, metric, round(value, 3) AS value FROM (SELECT id, year, CAST(n_orders AS DOUBLE) AS n_orders, CAST(spend AS DOUBLE) AS spend FROM panel) UNPIVOT (value FOR metric IN (n_orders, spend))")
def _(spark, sf):
    p = panel_cy(spark, sf).select("id", "year", F.col("n_orders").cast("double").alias("n_orders"), F.col("spend").cast("double").alias("spend"))
    return p.unpivot(["id", "year"], ["n_orders", "spend"], "metric", "value").withColumn("value", F.round("value", 3))


@query("event_type_crosstab", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def _(spark, sf):
    kinds = ["click", "view", "purchase"]
    got = table(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).count()
    return got.fillna(0, kinds)


@query("order_full_outer", "SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, 0) AS n_orders, coalesce(b.n, 0) AS n_events FROM (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1) b ON a.id = b.id")
def _(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    b = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_events"))
    return a.join(b, "id", "full").fillna(0)


@query("semi_anti_customers", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_order FROM customer")
def _(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_semi").withColumn("has_order", F.lit(True)).union(c.join(o, on, "left_anti").withColumn("has_order", F.lit(False)))


@query("weighted_mean", "SELECT p_brand, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS wmean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.round(SC.ratio(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), F.sum("l_quantity")), 4).alias("wmean"))


@query(
    "winsorize",
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) AS v FROM orders, q",
)
def _(spark, sf):
    return winsorize(table(spark, sf, "orders"), ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 4).alias("v"))


@query(
    "quantile_bins",
    f"""WITH {PANEL}, q AS (SELECT quantile_cont(spend, 0) AS qa, quantile_cont(spend, 1/3) AS qb, quantile_cont(spend, 2/3) AS qc, quantile_cont(spend, 1) AS qd FROM panel WHERE g > 0 AND spend > 0)
SELECT id, year, CASE WHEN spend >= qa AND spend <= qb THEN 0 WHEN spend > qb AND spend <= qc THEN 1 WHEN spend > qc AND spend <= qd THEN 2 END AS bin FROM panel, q WHERE spend > 0""",
)
def _(spark, sf):
    p = panel_cy(spark, sf).where("spend > 0").withColumn("t", (F.col("g") > 0).cast("int"))
    return H.quantile_z(p, "spend", "t", 3, "bin").select("id", "year", "bin")


@query("baseline_z", f"WITH {PANEL}, b AS (SELECT id, x AS z FROM panel WHERE k = -1) SELECT id, year, z FROM panel LEFT JOIN b USING (id)")
def _(spark, sf):
    return H.baseline_z(panel_cy(spark, sf), "id", "k", "x", "z").select("id", "year", "z")


@query(
    "within_firm_upper_half",
    f"""WITH {PANEL}, b AS (SELECT id, segment, x, (rank() OVER (PARTITION BY segment ORDER BY x) + (count(*) OVER (PARTITION BY segment, x) - 1) / 2.0) / count(*) OVER (PARTITION BY segment) AS p, count(*) OVER (PARTITION BY segment) AS n FROM panel WHERE k = -1)
SELECT id, year, CAST(b.p >= 0.5 AS INT) AS upper FROM panel LEFT JOIN b USING (id)""",
)
def _(spark, sf):
    return H.within_firm_upper_half(panel_cy(spark, sf), "id", "segment", "k", "x", "upper").select("id", "year", "upper")


@query("ratio_columns", "SELECT o_orderkey, round(o_totalprice / nullif(o_custkey % 5, 0), 4) AS ratio, round(CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE least(greatest(o_totalprice - 200000, 0), 100000) END, 4) AS clipped, year(o_orderdate) - CASE WHEN month(o_orderdate) >= 6 THEN 0 ELSE 1 END AS fyear, CAST(last_day(o_orderdate) AS DATE) AS month_end FROM orders")
def _(spark, sf):
    v = F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice") - 200000)
    return table(spark, sf, "orders").select("o_orderkey", F.round(SC.ratio(F.col("o_totalprice"), F.col("o_custkey") % 5), 4).alias("ratio"), F.round(SC.clip(v, 0.0, 100000.0), 4).alias("clipped"), SC.fiscal_year(F.col("o_orderdate")).cast("long").alias("fyear"), SC.month_end(F.col("o_orderdate")).alias("month_end"))


@query(
    "code_functions",
    """SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 2, '0') AS code, CASE WHEN length(CAST(p_partkey AS VARCHAR)) = 3 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE ltrim(CAST(p_partkey AS VARCHAR), '0') END AS sic,
  CAST(least(100, p_size * 3.0) AS DOUBLE) AS pct, upper(substr(p_name, 1, 6)) AS cusip, least(p_size, 25) || '~' || greatest(p_size, 25) AS pair,
  NOT (starts_with(CAST(p_partkey AS VARCHAR), '6') OR starts_with(CAST(p_partkey AS VARCHAR), '49') OR starts_with(CAST(p_partkey AS VARCHAR), '9')) AS kept, CASE WHEN p_size < 5 THEN '***' WHEN p_size < 25 THEN '**' WHEN p_size < 50 THEN '*' ELSE '' END AS stars FROM part""",
)
def _(spark, sf):
    pair = SC.pair_key(F.col("p_size"), F.lit(25))
    return table(spark, sf, "part").select(
        "p_partkey", SC.zero_pad(F.col("p_size")).alias("code"), SC.industry_code(F.col("p_partkey")).alias("sic"), SC.percent(F.concat(F.lit("about "), F.col("p_size") * 3, F.lit("%"))).alias("pct"),
        SC.cusip6(F.col("p_name")).alias("cusip"), F.concat_ws("~", pair["a"].cast("string"), pair["b"].cast("string")).alias("pair"), SC.excluded_prefix(F.col("p_partkey").cast("string")).alias("kept"), SC.stars(F.col("p_size") / 500).alias("stars"),
    )


@query("coerce_ids", "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE TRY_CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    return coerce_ids(e, "k")


@query("null_out_negatives", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf):
    return assert_unique(null_out_negatives(table(spark, sf, "customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal"), "c_custkey")


_T = "CASE WHEN g > 0 THEN 1 ELSE 0 END"


def _t(spark, sf):
    return panel_cy(spark, sf).withColumn("t", (F.col("g") > 0).cast("int"))


@query(
    "smd",
    f"""WITH {PANEL}, p AS (SELECT *, {_T} AS t FROM panel WHERE year = 1997), v AS (SELECT 'n_orders' AS variable, CAST(n_orders AS DOUBLE) AS v, t FROM p UNION ALL SELECT 'spend', spend, t FROM p)
SELECT variable, round((avg(v) FILTER (t = 1) - avg(v) FILTER (t = 0)) / sqrt(0.5 * (var_samp(v) FILTER (t = 1) + var_samp(v) FILTER (t = 0))), 5) AS smd, round(avg(v) FILTER (t = 1), 3) AS m1, count(*) FILTER (t = 1) AS n1 FROM v GROUP BY 1""",
)
def _(spark, sf):
    return Q.smd(_t(spark, sf).where("year = 1997"), "t", ["n_orders", "spend"]).select("variable", r("smd"), r("m1", 3), "n1")


@query(
    "welch_ttest",
    f"""WITH {PANEL}, p AS (SELECT *, {_T} AS t FROM panel WHERE year = 1997),
a AS (SELECT avg(x) FILTER (t = 1) AS m1, avg(x) FILTER (t = 0) AS m0, var_samp(x) FILTER (t = 1) / count(*) FILTER (t = 1) AS v1, var_samp(x) FILTER (t = 0) / count(*) FILTER (t = 0) AS v0, count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0 FROM p),
b AS (SELECT m1 - m0 AS diff, (m1 - m0) / sqrt(v1 + v0) AS t, (v1 + v0) * (v1 + v0) / (v1 * v1 / (n1 - 1) + v0 * v0 / (n0 - 1)) AS df FROM a),
-- both tails: with t = sqrt(df) tan(h) the density is that of cos(h) ^ (df - 1); Simpson's rule over 4,000 steps
h AS (SELECT *, atan(abs(t) / sqrt(df)) AS h0 FROM b),
g AS (SELECT i / 4000.0 AS u, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(4001) s(i)),
i AS (SELECT any_value(diff) AS diff, any_value(t) AS t, any_value(df) AS df, (1 - any_value(h0) / (pi() / 2)) * sum(w * pow(greatest(cos(h0 + u * (pi() / 2 - h0)), 0), df - 1)) / sum(w * pow(greatest(cos(u * pi() / 2), 0), df - 1)) AS p FROM h, g)
SELECT 'x' AS variable, round(diff, 5) AS diff, round(t, 4) AS t, round(df, 3) AS df, round(p, 6) AS p FROM i""",
)
def _(spark, sf):
    return Q.welch(_t(spark, sf).where("year = 1997"), "t", ["x"]).select("variable", r("diff"), r("t", 4), r("df", 3), r("p", 6))


@query("panel_overview", f"WITH {PANEL}, p AS (SELECT *, {_T} AS t FROM panel), a AS (SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(count(DISTINCT id) AS DOUBLE) AS entities, CAST(count(DISTINCT year) AS DOUBLE) AS periods, CAST(min(k) AS DOUBLE) AS k_min, CAST(max(k) AS DOUBLE) AS k_max, CAST(count(*) FILTER (k < 0) AS DOUBLE) AS rows_pre, CAST(count(*) FILTER (k >= 0) AS DOUBLE) AS rows_post, CAST(sum(t) AS DOUBLE) AS rows_treated, CAST(count(DISTINCT CASE WHEN t = 1 THEN id END) AS DOUBLE) AS entities_treated, avg(t) AS share_treated FROM p) SELECT metric, round(value, 5) AS value FROM a UNPIVOT (value FOR metric IN (rows, entities, periods, k_min, k_max, rows_pre, rows_post, rows_treated, entities_treated, share_treated))")
def _(spark, sf):
    return Q.overview(_t(spark, sf), "id", "year", "k", "t").withColumn("value", F.round("value", 5))


@query("pre_period_means", f"WITH {PANEL}, p AS (SELECT *, {_T} AS t FROM panel WHERE year < 1998), g AS (SELECT 'all' AS grp, x FROM p UNION ALL SELECT CASE WHEN t = 1 THEN 'treated' ELSE 'control' END, x FROM p) SELECT 'x' AS variable, grp, count(*) AS n, round(avg(x), 5) AS mean, median(x) AS median, round(stddev_samp(x), 5) AS sd FROM g GROUP BY 2")
def _(spark, sf):
    return Q.baseline_table(_t(spark, sf).where("year < 1998"), "t", ["x"]).select("variable", "grp", "n", r("mean"), "median", r("sd"))


@query(
    "outcome_profile",
    f"""WITH {PANEL}, a AS (SELECT segment, count(spend) AS n, avg(spend) AS mean, stddev_samp(spend) AS sd, min(spend) AS min, max(spend) AS max, quantile_cont(spend, [0.01, 0.05, 0.5, 0.95, 0.99]) AS q, avg(CAST(spend = 0 AS INT)) AS zero_share, avg(CAST(spend < 0 AS INT)) AS negative_share FROM panel GROUP BY 1)
SELECT segment, n, round(mean, 3) AS mean, round(sd, 3) AS sd, round(min, 3) AS min, round(max, 3) AS max, round(q[1], 3) AS p01, round(q[2], 3) AS p05, round(q[3], 3) AS p50, round(q[4], 3) AS p95, round(q[5], 3) AS p99, round(zero_share, 5) AS zero_share, round(negative_share, 5) AS negative_share,
  concat_ws('; ', CASE WHEN n < 500 THEN 'fewer than 500 rows' END, CASE WHEN coalesce(sd, 0) = 0 THEN 'no variation' END, CASE WHEN q[3] <> 0 AND q[5] / q[3] > 50 THEN 'p99 over 50 times the median' END, CASE WHEN q[5] <> 0 AND max / q[5] > 5 THEN 'maximum over 5 times p99' END) AS flags FROM a""",
)
def _(spark, sf):
    places = {"mean": 3, "sd": 3, "min": 3, "max": 3, "p01": 3, "p05": 3, "p50": 3, "p95": 3, "p99": 3, "zero_share": 5, "negative_share": 5}
    return Q.rule_flags(Q.profile(panel_cy(spark, sf), "segment", "spend")).select("segment", "n", *[r(c, n) for c, n in places.items()], "flags")


@query(
    "collinearity",
    f"""WITH {PANEL}, p AS (SELECT *, x * 2 AS x2 FROM panel), e AS (SELECT id FROM p GROUP BY 1 HAVING max(x) > min(x) OR max(spend) > min(spend)), t AS (SELECT year FROM p GROUP BY 1 HAVING max(x) > min(x) OR max(spend) > min(spend))
SELECT count(*) AS n, 2 AS rank, 1 AS deficiency, CAST(bool_and(x = x2) AS INT) + CAST(bool_and(x = spend) AS INT) + CAST(bool_and(x2 = spend) AS INT) AS equal_pairs, CAST(corr(x, x2) > 0.999999 AS INT) + 2 * CAST(abs(corr(x, spend)) > 0.999999 AS INT) AS near_pairs, (SELECT count(*) FROM e) AS entities_varying, (SELECT count(*) FROM t) AS periods_varying FROM p""",
)
def _(spark, sf):
    p = panel_cy(spark, sf).withColumn("x2", F.col("x") * 2)
    return Q.collinearity(p, ["x", "x2", "spend"], "id", "year").select("n", "rank", "deficiency", "equal_pairs", "near_pairs", "entities_varying", "periods_varying")


@query("balance_check", f"WITH {_BALANCED} SELECT count(DISTINCT (id, g, is_control_event)) AS n_events, 0 AS n_unbalanced FROM b")
def _(spark, sf):
    return Q.window_balance(_balanced(spark, sf), ["id", "g", "is_control_event"], "k", -2, 2)


@query("rows_per_k", f"WITH {_BALANCED} SELECT k, count(*) FILTER (is_control_event = 0) AS n_treated, count(*) FILTER (is_control_event = 1) AS n_control FROM b GROUP BY 1")
def _(spark, sf):
    return Q.rows_per_k(_balanced(spark, sf).withColumn("t", 1 - F.col("is_control_event")), "k", "t")


@query("reuse_stats", "WITH p AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), n AS (SELECT l_suppkey, count(*) AS n FROM p GROUP BY 1) SELECT count(*) AS n_controls, round(avg(CAST(n > 1 AS INT)), 5) AS share_reused, max(n) AS max_reuse FROM n")
def _(spark, sf):
    return Q.reuse_stats(table(spark, sf, "lineitem"), "l_suppkey", ["l_orderkey"]).withColumn("share_reused", F.round("share_reused", 5))


@query("top_reused", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, sf):
    return Q.top_reused(table(spark, sf, "lineitem"), "l_suppkey", ["l_orderkey"])


@query("grid_completeness", "WITH d AS (SELECT user_id, count(DISTINCT day(ts)) AS n, max(day(ts)) - min(day(ts)) + 1 AS span FROM events GROUP BY 1) SELECT count(*) AS n_entities, round(avg(CAST(n = span AS INT)), 5) AS share_complete FROM d")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.dayofmonth("ts"))
    return Q.grid_completeness(e, "user_id", "d").withColumn("share_complete", F.round("share_complete", 5))
