"""Queries on documents, moves and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import sum0
from ..operators import docs as D
from ..operators import moves as M
from ..operators import similarity as S
from ..operators.panels import relative_talent
from .domain import DOCS, MOVES, SEGMENTS, docs, moves, moves_and_rows, segment_rows, table
from .registry import query

R = lambda c: F.round(c, 5).alias(c) if isinstance(c, str) else F.round(c, 5)


@query("forward_citations", "SELECT l_partkey AS cited, count(DISTINCT l_orderkey) AS forward_citations FROM lineitem GROUP BY 1")
def _(spark, sf):
    return D.forward_citations(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey").withColumnRenamed("l_partkey", "cited")


def _cited(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    n = D.forward_citations(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    return p.join(n, p.p_partkey == n.l_partkey, "left").drop("l_partkey")


_CITED = """c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS forward_citations FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey, p_type, p_size, forward_citations FROM part LEFT JOIN c ON p_partkey = l_partkey)"""


@query(
    "quality_bins",
    f"""WITH {_CITED}, q AS (SELECT p_type, quantile_cont(coalesce(forward_citations, 0), 0.9) AS lo, quantile_cont(coalesce(forward_citations, 0), 0.99) AS hi FROM p GROUP BY 1),
x AS (SELECT p.*, coalesce(forward_citations, 0) AS c, lo, hi FROM p LEFT JOIN q USING (p_type))
SELECT p_partkey, p_type, CAST(c > 0 AND c >= hi AS INT) AS top1, CAST(c > 0 AND c >= lo AND c < hi AS INT) AS top10_to_2,
       CAST(c > 0 AND c < lo AS INT) AS cited, CAST(c = 0 AS INT) AS uncited FROM x""",
)
def _(spark, sf):
    return D.quality_bins(_cited(spark, sf), "forward_citations", ["p_type"]).select("p_partkey", "p_type", "top1", "top10_to_2", "cited", "uncited")


@query(
    "quality_bins_external",
    f"""WITH {_CITED}, e AS (SELECT p_partkey, p_type, CASE WHEN p_size > 5 THEN p_size - 10 END AS v FROM p),
q AS (SELECT p_type, quantile_cont(v, 0.9) AS lo, quantile_cont(v, 0.99) AS hi FROM e GROUP BY 1)
SELECT p_partkey, CASE WHEN v IS NOT NULL THEN CAST(v > 0 AND v >= hi AS INT) END AS top1, CASE WHEN v IS NOT NULL THEN CAST(v >= lo AND v < hi AS INT) END AS top10_to_2,
       CASE WHEN v IS NOT NULL THEN CAST(v > 0 AND v < lo AS INT) END AS cited, CASE WHEN v IS NOT NULL THEN CAST(v = 0 AS INT) END AS uncited FROM e LEFT JOIN q USING (p_type)""",
)
def _(spark, sf):
    x = _cited(spark, sf).withColumn("v", F.when(F.col("p_size") > 5, F.col("p_size") - 10))
    return D.quality_bins(x, "v", ["p_type"], external=True).select("p_partkey", "top1", "top10_to_2", "cited", "uncited")


def _novelty_sql(cls):
    return f"""WITH {DOCS}, s AS (SELECT DISTINCT doc_id, filing_date, {cls} AS c FROM docs),
pr AS (SELECT a.doc_id, a.filing_date, a.c AS x, b.c AS y FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.c < b.c),
n AS (SELECT *, min(filing_date) OVER (PARTITION BY x, y) = filing_date AS isnew FROM pr),
t AS (SELECT doc_id, CAST(sum(isnew::INT) AS BIGINT) AS new_pairs, count(*) AS total_pairs FROM n GROUP BY 1)
SELECT d.doc_id, coalesce(new_pairs, 0) AS new_pairs, coalesce(total_pairs, 0) AS total_pairs, round(coalesce(new_pairs / total_pairs, 0), 5) AS novelty
FROM (SELECT DISTINCT doc_id FROM docs) d LEFT JOIN t USING (doc_id)"""


for _level, _cls in (("class", "class"), ("group", "grp")):

    @query(f"pair_novelty_{_level}", _novelty_sql(_cls))
    def _(spark, sf, cls=_cls):
        return D.pair_novelty(docs(spark, sf), "doc_id", "filing_date", cls).withColumn("novelty", F.round("novelty", 5))


@query(
    "citation_links",
    """WITH e AS (SELECT DISTINCT l_orderkey AS x, l_partkey AS y FROM lineitem),
o AS (SELECT DISTINCT o_orderkey AS d, c_nationkey AS o FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT DISTINCT l_partkey AS d, s_nationkey AS o FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
s AS (SELECT DISTINCT x, y FROM e JOIN o ON e.x = o.d JOIN p ON e.y = p.d AND p.o = o.o)
SELECT e.x AS citing, count(*) AS backward, count(s.y) AS self_citations FROM e LEFT JOIN s ON e.x = s.x AND e.y = s.y GROUP BY 1""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("d"), F.col("c_nationkey").alias("o"))
    p = li.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("d"), F.col("s_nationkey").alias("o"))
    # documents and cited ones have ids of their own: the two kinds are told apart by sign
    owners = o.withColumn("d", -F.col("d") - 1).union(p)
    edges = li.select((-F.col("l_orderkey") - 1).alias("x"), F.col("l_partkey").alias("y"))
    got = D.citation_links(edges, owners, "x", "y", "d", "o")
    return got.select((-F.col("x") - 1).alias("citing"), "backward", "self_citations")


def _exploration_sql(actor):
    return f"""WITH {DOCS}, r AS (SELECT DISTINCT doc_id, year, class FROM docs), a AS (SELECT DISTINCT {actor} AS a, doc_id, year, class FROM docs),
k AS (SELECT DISTINCT n.doc_id, n.class FROM a n JOIN a o ON n.a = o.a AND n.class = o.class
      AND (o.year < n.year OR (o.year = n.year AND o.doc_id < n.doc_id)) AND o.year >= n.year - 2)
SELECT r.doc_id, round(1 - avg((k.class IS NOT NULL)::INT), 5) AS exploration, round(avg((k.class IS NOT NULL)::INT), 5) AS exploitation
FROM r LEFT JOIN k ON r.doc_id = k.doc_id AND r.class = k.class GROUP BY 1"""


for _actor in ("person", "firm"):

    @query(f"exploration_{_actor}", _exploration_sql(_actor))
    def _(spark, sf, actor=_actor):
        got = D.exploration(docs(spark, sf), "doc_id", "year", "class", actor, 2)
        return got.select("doc_id", R("exploration"), R("exploitation"))


@query(
    "career_team_size",
    f"""WITH {DOCS}, t AS (SELECT doc_id, count(DISTINCT person) AS team_size FROM docs GROUP BY 1),
f AS (SELECT person, min(year) AS first_year, arg_min(class, (filing_date, doc_id, line, part_id)) AS first_class FROM docs GROUP BY 1)
SELECT doc_id, line, part_id, person, team_size, first_class, year - first_year AS age, CAST(class = first_class AS INT) AS same_first_class FROM docs JOIN t USING (doc_id) JOIN f USING (person)""",
)
def _(spark, sf):
    got = D.career(docs(spark, sf), "person", "doc_id", "year", "class", ["filing_date", "doc_id", "line", "part_id"])
    return got.select("doc_id", "line", "part_id", "person", "team_size", "first_class", "age", "same_first_class")


@query(
    "stable_moves_users",
    """WITH l AS (SELECT *, lag(event_type, 1) OVER w AS p1, lag(event_type, 2) OVER w AS p2, lead(event_type, 1) OVER w AS n1, lead(event_type, 2) OVER w AS n2,
  count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, p1 AS from_state, event_type AS to_state FROM l WHERE n >= 5 AND event_type <> p1 AND p2 = p1 AND n1 = event_type AND n2 = n1
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, p1 ORDER BY ts, event_id) = 1""",
)
def _(spark, sf):
    return M.stable_moves(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "from_state", "to_state")


@query("stable_moves_suppliers", f"WITH {MOVES} SELECT person, doc_id, line, part_id, from_state, to_state, move_year FROM moves")
def _(spark, sf):
    return moves(spark, sf).select("person", "doc_id", "line", "part_id", "from_state", "to_state", "move_year")


_AROUND = MOVES + """, m AS (SELECT DISTINCT person, move_year FROM moves),
x AS (SELECT m.person, m.move_year, seg.doc_id, seg.value, seg.qty, seg.ship_year - m.move_year AS rel FROM m JOIN seg ON seg.person = m.person
      WHERE seg.ship_year - m.move_year BETWEEN -2 AND 1),
p AS (SELECT *, CASE WHEN rel < 0 THEN 'pre' ELSE 'post' END AS period FROM x)"""


def _around(spark, sf):
    return M.performance_around(*moves_and_rows(spark, sf, "value", "qty"), "person", "move_year", "ship_year", {"n_docs": "doc_id"}, ["value"], ["qty"], 2)


@query("performance_around_long", f"WITH {_AROUND} SELECT person, move_year, period, count(DISTINCT doc_id) AS n_docs, round(coalesce(sum(value), 0), 2) AS sum_value, round(avg(qty), 5) AS mean_qty FROM p GROUP BY 1, 2, 3")
def _(spark, sf):
    return _around(spark, sf)["long"].select("person", "move_year", "period", "n_docs", F.round("sum_value", 2).alias("sum_value"), R("mean_qty"))


@query(
    "performance_around_wide",
    f"""WITH {_AROUND}, l AS (SELECT person, move_year, period, count(DISTINCT doc_id) AS n_docs, coalesce(sum(value), 0) AS v FROM p GROUP BY 1, 2, 3),
w AS (SELECT person, move_year, max(n_docs) FILTER (period = 'pre') AS a, max(n_docs) FILTER (period = 'post') AS b, max(v) FILTER (period = 'pre') AS c, max(v) FILTER (period = 'post') AS d FROM l GROUP BY 1, 2)
SELECT person, move_year, a AS pre_n_docs, b AS post_n_docs, b - a AS change_n_docs, round(d - c, 2) AS change_sum_value FROM w""",
)
def _(spark, sf):
    return _around(spark, sf)["wide"].select("person", "move_year", "pre_n_docs", "post_n_docs", "change_n_docs", F.round("change_sum_value", 2).alias("change_sum_value"))


@query("performance_around_annual", f"WITH {_AROUND} SELECT person, move_year, rel, count(DISTINCT doc_id) AS n_docs, round(coalesce(sum(value), 0), 2) AS sum_value, round(avg(qty), 5) AS mean_qty FROM p GROUP BY 1, 2, 3")
def _(spark, sf):
    return _around(spark, sf)["annual"].select("person", "move_year", "rel", "n_docs", F.round("sum_value", 2).alias("sum_value"), R("mean_qty"))


@query(
    "performance_around_annual_wide",
    f"""WITH {_AROUND}, a AS (SELECT person, move_year, rel, count(DISTINCT doc_id) AS n FROM p GROUP BY 1, 2, 3)
SELECT person, move_year, max(n) FILTER (rel = -2) AS m2_n_docs, max(n) FILTER (rel = -1) AS m1_n_docs, max(n) FILTER (rel = 0) AS p0_n_docs, max(n) FILTER (rel = 1) AS p1_n_docs FROM a GROUP BY 1, 2""",
)
def _(spark, sf):
    return _around(spark, sf)["annual_wide"].select("person", "move_year", "m2_n_docs", "m1_n_docs", "p0_n_docs", "p1_n_docs")


_PEER_PARTS = "".join(
    f""", {n} AS (SELECT m.person, m.move_year, m.from_state, m.to_state, avg(value) FILTER (r.person = m.person) AS mm, avg(value) FILTER (r.person <> m.person) AS pm,
  count(DISTINCT doc_id) FILTER (r.person = m.person) AS md, count(DISTINCT doc_id) FILTER (r.person <> m.person) AS pd
  FROM m LEFT JOIN seg r ON r.state = m.{at} AND r.ship_year - m.move_year BETWEEN {lo} AND {hi} GROUP BY 1, 2, 3, 4)"""
    for n, at, lo, hi in (("op", "from_state", -2, -1), ("dp", "to_state", -2, -1), ("dq", "to_state", 0, 1))
)


@query(
    "peer_benchmark",
    f"""WITH {MOVES}, m AS (SELECT DISTINCT person, move_year, from_state, to_state FROM moves){_PEER_PARTS}
SELECT op.person, op.move_year, op.from_state, op.to_state, round(op.mm + 1e-6, 3) AS mover_origin_pre, round(op.pm + 1e-6, 3) AS peers_origin_pre, round(dp.pm + 1e-6, 3) AS peers_dest_pre,
  round(dq.mm + 1e-6, 3) AS mover_dest_post, round(dq.pm + 1e-6, 3) AS peers_dest_post, op.md AS mover_docs_origin_pre, op.pd AS peers_docs_origin_pre, dq.pd AS peers_docs_dest_post,
  round(op.mm / (op.pm + 1e-9), 5) AS ratio_origin, round(dq.mm / (dq.pm + 1e-9), 5) AS ratio_dest
FROM op JOIN dp USING (person, move_year, from_state, to_state) JOIN dq USING (person, move_year, from_state, to_state)""",
)
def _(spark, sf):
    m, rows = moves_and_rows(spark, sf, "value")
    got = M.peer_benchmark(m, rows.withColumnRenamed("state", "place"), "person", "place", "ship_year", "doc_id", "value", 2)
    # a mean of cents often ends in an exact 5, which sums in another order would round the other way
    three = [F.round(F.col(c) + 1e-6, 3).alias(c) for c in ("mover_origin_pre", "peers_origin_pre", "peers_dest_pre", "mover_dest_post", "peers_dest_post")]
    return got.select("person", "move_year", "from_state", "to_state", *three, "mover_docs_origin_pre", "peers_docs_origin_pre", "peers_docs_dest_post", R("ratio_origin"), R("ratio_dest"))


@query(
    "relative_talent",
    f"""WITH {MOVES}, m AS (SELECT DISTINCT person, move_year, from_state, to_state FROM moves){_PEER_PARTS}, z AS (SELECT op.person, move_year, from_state, to_state, op.mm / (op.pm + 1e-9) AS a, op.md / (op.pd + 1e-9) AS b, dq.mm / (dq.pm + 1e-9) AS c FROM op JOIN dq USING (person, move_year, from_state, to_state)),
o AS (SELECT from_state AS firm, move_year AS data_year, avg(a) AS v, avg(b) AS n FROM z GROUP BY 1, 2), d AS (SELECT to_state AS firm, move_year AS data_year, avg(c) AS v FROM z GROUP BY 1, 2)
SELECT firm, data_year, round(o.v, 5) AS value_departures, round(o.n, 5) AS docs_departures, round(d.v, 5) AS value_arrivals FROM o FULL JOIN d USING (firm, data_year)""",
)
def _(spark, sf):
    m, rows = moves_and_rows(spark, sf, "value")
    b = M.peer_benchmark(m, rows.withColumnRenamed("state", "place"), "person", "place", "ship_year", "doc_id", "value", 2)
    got = relative_talent(b, {"ratio_origin": "value_departures", "docs_ratio_origin": "docs_departures"}, {"ratio_dest": "value_arrivals"})
    return got.select("firm", "data_year", R("value_departures"), R("docs_departures"), R("value_arrivals"))


def _cos(keys, vectors, pairs):
    """SQL of cosines: vectors are CTE names with (keys, c, n)."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    out = []
    for name, (a, b) in pairs.items():
        out.append(f"""c_{name} AS (SELECT k.*, (SELECT sum({a}.n * {b}.n) FROM {a} JOIN {b} ON {on(a, b)} AND {a}.c = {b}.c WHERE {on(a, 'k')})
  / sqrt((SELECT sum(n * n) FROM {a} WHERE {on(a, 'k')}) * (SELECT sum(n * n) FROM {b} WHERE {on(b, 'k')})) AS s,
  EXISTS (SELECT 1 FROM {a} WHERE {on(a, 'k')}) AND EXISTS (SELECT 1 FROM {b} WHERE {on(b, 'k')}) AS ok FROM k)""")
    ks = ", ".join(f"k.{x}" for x in keys)
    cols = ", ".join(f"round(CASE WHEN c_{n}.ok THEN coalesce(c_{n}.s, 0) END, 5) AS {n}" for n in pairs)
    return ", ".join(out) + f" SELECT {ks}, {cols} FROM k " + " ".join(f"JOIN c_{n} ON {on('c_' + n, 'k')}" for n in pairs)


_PROX = {"inv_pre_post": ("ip", "iq"), "from_pre_post": ("fp", "fq"), "to_pre_post": ("tp", "tq"), "inv_from_pre": ("ip", "fp"), "inv_to_pre": ("ip", "tp"), "inv_to_post": ("iq", "tq"), "from_to_pre": ("fp", "tp")}
_PROX_VECTORS = ", ".join(
    f"{n} AS (SELECT k.person, k.move_year, k.from_state, k.to_state, class AS c, count(DISTINCT doc_id, ship_year)::DOUBLE AS n FROM k JOIN seg ON seg.{col} = k.{key} AND ship_year - k.move_year BETWEEN {lo} AND {hi} GROUP BY 1, 2, 3, 4, 5)".replace("count(DISTINCT doc_id, ship_year)", "count(DISTINCT (doc_id, ship_year))")
    for who, col, key in (("i", "person", "person"), ("f", "state", "from_state"), ("t", "state", "to_state"))
    for n, lo, hi in ((who + "p", -4, 0), (who + "q", 1, 5))
)


@query("event_proximity", f"WITH {MOVES}, k AS (SELECT DISTINCT person, move_year, from_state, to_state FROM moves), {_PROX_VECTORS}, " + _cos(["person", "move_year", "from_state", "to_state"], None, _PROX))
def _(spark, sf):
    got = S.event_proximity(*moves_and_rows(spark, sf, "class"), "person", "state", "ship_year", "class", "doc_id", 5)
    return got.select("person", "move_year", "from_state", "to_state", *[R(c) for c in _PROX])


_ROLL = {"inv_self": ("inow", "ihist"), "inv_from": ("inow", "fhist"), "inv_to": ("inow", "thist"), "hist_from": ("ihist", "fhist"), "hist_to": ("ihist", "thist")}


@query(
    "rolling_similarity",
    f"""WITH {MOVES}, act AS (SELECT DISTINCT person, ship_year FROM seg), m AS (SELECT DISTINCT person, from_state, to_state FROM moves),
k AS (SELECT m.person, from_state, to_state, ship_year FROM m JOIN act USING (person)),
inow AS (SELECT k.person, k.from_state, k.to_state, k.ship_year, class AS c, count(*)::DOUBLE AS n FROM k JOIN seg ON seg.person = k.person AND seg.ship_year = k.ship_year GROUP BY 1, 2, 3, 4, 5),
ihist AS (SELECT k.person, k.from_state, k.to_state, k.ship_year, class AS c, count(*)::DOUBLE AS n FROM k JOIN seg ON seg.person = k.person AND seg.ship_year BETWEEN k.ship_year - 2 AND k.ship_year - 1 GROUP BY 1, 2, 3, 4, 5),
fhist AS (SELECT k.person, k.from_state, k.to_state, k.ship_year, class AS c, count(*)::DOUBLE AS n FROM k JOIN seg ON seg.state = k.from_state AND seg.ship_year BETWEEN k.ship_year - 2 AND k.ship_year - 1
  JOIN act ON act.person = k.person AND act.ship_year = seg.ship_year GROUP BY 1, 2, 3, 4, 5),
thist AS (SELECT k.person, k.from_state, k.to_state, k.ship_year, class AS c, count(*)::DOUBLE AS n FROM k JOIN seg ON seg.state = k.to_state AND seg.ship_year BETWEEN k.ship_year - 2 AND k.ship_year - 1
  JOIN act ON act.person = k.person AND act.ship_year = seg.ship_year GROUP BY 1, 2, 3, 4, 5), """
    + _cos(["person", "from_state", "to_state", "ship_year"], None, _ROLL),
)
def _(spark, sf):
    got = S.rolling_similarity(*moves_and_rows(spark, sf, "class"), "person", "state", "ship_year", "class", 2)
    return got.select("person", "from_state", "to_state", "ship_year", *[R(c) for c in _ROLL])


@query(
    "rolling_self_similarity",
    f"""WITH {DOCS}, n AS (SELECT firm, year, class, count(*)::DOUBLE AS n FROM docs GROUP BY 1, 2, 3), k AS (SELECT DISTINCT firm, year FROM n),
h AS (SELECT k.firm, k.year, class, sum(n) AS n FROM k JOIN n ON n.firm = k.firm AND n.year BETWEEN k.year - 2 AND k.year - 1 GROUP BY 1, 2, 3),
d AS (SELECT n.firm, n.year, sum(n.n * h.n) AS dot FROM n JOIN h USING (firm, year, class) GROUP BY 1, 2),
a AS (SELECT firm, year, sum(n * n) AS s FROM n GROUP BY 1, 2), b AS (SELECT firm, year, sum(n * n) AS s FROM h GROUP BY 1, 2)
SELECT a.firm, a.year, round(coalesce(dot, 0) / sqrt(a.s * b.s), 5) AS similarity FROM a JOIN b USING (firm, year) LEFT JOIN d USING (firm, year)""",
)
def _(spark, sf):
    return S.rolling_self_similarity(docs(spark, sf), "firm", "year", "class", 2).withColumn("similarity", F.round("similarity", 5))


@query(
    "pairwise_similarity",
    f"""WITH {MOVES}, k AS (SELECT DISTINCT from_state, to_state, move_year FROM moves),
va AS (SELECT k.*, class AS c, count(DISTINCT (doc_id, ship_year))::DOUBLE AS n FROM k JOIN seg ON seg.state = k.from_state AND ship_year BETWEEN move_year - 1 AND move_year GROUP BY ALL),
vb AS (SELECT k.*, class AS c, count(DISTINCT (doc_id, ship_year))::DOUBLE AS n FROM k JOIN seg ON seg.state = k.to_state AND ship_year BETWEEN move_year - 1 AND move_year GROUP BY ALL), """
    + _cos(["from_state", "to_state", "move_year"], None, {"similarity": ("va", "vb")}),
)
def _(spark, sf):
    got = S.pairwise_similarity(*moves_and_rows(spark, sf, "class"), "from_state", "to_state", "move_year", "state", "ship_year", "class", "doc_id", 2)
    return got.withColumn("similarity", F.round("similarity", 5))


@query(
    "map_cosine",
    f"""WITH {DOCS}, n AS (SELECT firm, year, class, count(*)::DOUBLE AS n FROM docs GROUP BY 1, 2, 3), s AS (SELECT firm, year, sum(n * n) AS s FROM n GROUP BY 1, 2),
d AS (SELECT a.firm, a.year, sum(a.n * b.n) AS dot FROM n a JOIN n b ON a.firm = b.firm AND a.class = b.class AND b.year = a.year + 1 GROUP BY 1, 2)
SELECT s.firm, s.year, round(coalesce(dot, 0) / sqrt(s.s * z.s), 5) AS similarity FROM s JOIN s z ON z.firm = s.firm AND z.year = s.year + 1 LEFT JOIN d ON d.firm = s.firm AND d.year = s.year""",
)
def _(spark, sf):
    n = docs(spark, sf).groupBy("firm", "year", "class").agg(F.count("*").cast("double").alias("n"))
    maps = n.groupBy("firm", "year").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("m"))
    after = maps.select("firm", (F.col("year") - 1).alias("year"), F.col("m").alias("z"))
    got = maps.join(after, ["firm", "year"]).select("firm", "year", S.map_cosine(F.col("m"), F.col("z")).alias("similarity"))
    return got.withColumn("similarity", F.round("similarity", 5))


@query("class_shares", f"WITH {SEGMENTS} SELECT state, class, count(*) AS n, round(coalesce(sum(value), 0), 2) AS value FROM seg GROUP BY 1, 2")
def _(spark, sf):
    return segment_rows(spark, sf).groupBy("state", "class").agg(F.count("*").alias("n"), F.round(sum0("value"), 2).alias("value"))


