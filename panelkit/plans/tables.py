"""Queries on accounting and deals, over statements and deals derived from customers' orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounting as A
from ..operators import deals as D
from .domain import table
from .registry import query

_AMOUNTS = "at sale teq intan mkvalt ppent ppegt dltt dlc csho prcc_f ajex xrd xad xsga xlr xint cogs che capx dp txdb re dv dvc dvp prstkc sstk oibdp oiadp ceq dltis dltr dlcch aqc wcap ib txt emp".split()
# missing amounts, negative ones that must go, zero denominators, and rows that each filter drops
_SHARES = {
    "teq": "total * CASE WHEN gid % 29 = 0 AND fyear = 1999 THEN -0.5 ELSE 0.5 END", "at": "CASE WHEN gid % 31 = 0 AND fyear % 2 = 0 THEN 0.0 ELSE total * (2 + gid % 3) END", "sale": "CASE WHEN gid % 19 = 0 AND fyear = 1997 THEN -total WHEN gid % 37 = 0 THEN NULL ELSE total END",
    "intan": "total * 0.1 * (1 - gid % 5)", "ppent": "total * (0.3 + 0.01 * n)", "ppegt": "CASE WHEN gid % 8 > 0 THEN total * 0.4 END", "dltt": "total * 0.2 * (gid % 3)", "dlc": "CASE WHEN gid % 17 = 0 THEN -total ELSE total * 0.1 END", "csho": "n * 10.0", "prcc_f": "CASE WHEN gid % 9 > 0 THEN 10.0 + gid % 7 END", "ajex": "CASE WHEN gid % 2 = 0 THEN 2.0 END",
    "xrd": "CASE WHEN gid % 4 > 0 THEN total * 0.05 END", "xlr": "-total", "xint": "CASE WHEN gid % 5 > 0 THEN total * 0.01 ELSE 0.0 END", "cogs": "total * 0.6", "che": "total * 0.15", "capx": "total * 0.08 * (1 - 2 * CAST(gid % 41 = 0 AS INT))", "dp": "CASE WHEN gid % 7 > 0 THEN total * 0.04 END",
    "dv": "CASE WHEN gid % 3 = 0 THEN total * (0.03 - 0.04 * (gid % 2)) END", "dvc": "CASE WHEN gid % 2 = 0 THEN total * 0.02 END", "dvp": "CASE WHEN gid % 13 = 0 THEN total * 0.01 END", "prstkc": "CASE WHEN gid % 11 > 0 THEN total * (0.01 - 0.02 * (gid % 2)) END", "sstk": "CASE WHEN gid % 6 > 0 THEN total * 0.004 END",
    "oibdp": "total * (0.2 - 0.1 * (gid % 4))", "oiadp": "total * 0.15", "ceq": "total * 0.7", "dltis": "total * 0.03", "dltr": "CASE WHEN gid % 5 > 1 THEN total * 0.02 END", "dlcch": "CASE WHEN gid % 5 = 3 THEN total * 0.01 END", "aqc": "CASE WHEN gid % 4 = 1 THEN total * 0.06 END", "wcap": "CASE WHEN gid % 12 > 0 THEN total * 0.25 END",
    "ib": "CASE WHEN gid % 14 > 0 THEN total * 0.07 END", "txt": "total * 0.02", "emp": "CASE WHEN gid % 3 > 0 THEN n * 1.5 END",
}
_TEXTS = {"pddur": "CASE WHEN gid % 23 = 0 AND fyear = 1998 THEN 6 ELSE 12 END", "ipodate": "CASE WHEN gid % 6 = 0 THEN '19890315' WHEN gid % 6 = 1 THEN 'unknown' END", "sic": "CASE WHEN gid % 10 = 0 THEN '6021' WHEN gid % 10 = 1 THEN '0100.0' ELSE '35' || CAST(gid % 3 AS VARCHAR(1)) || '1' END", "consol": "CASE WHEN gid % 43 = 0 THEN 'P' ELSE 'C' END"}

_RAW = """raw AS (
  SELECT *, {}, {} FROM (SELECT o_custkey AS gid, CAST(year(o_orderdate) AS BIGINT) AS fyear, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1, 2))""".format(", ".join(f"CAST({v} AS DOUBLE) AS {'assets' if k == 'at' else k}" for k, v in _SHARES.items()), ", ".join(f"{v} AS {k}" for k, v in _TEXTS.items()))


def statements(spark, sf):
    """Raw annual statements, one per customer and year with orders; some customers are of an excluded industry."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("gid"), F.year("o_orderdate").cast("long").alias("fyear")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    o = o.withColumns({k: F.expr(v).cast("double") for k, v in _SHARES.items()} | {k: F.expr(v) for k, v in _TEXTS.items()})
    o = o.withColumns({c: F.lit(None).cast("double") for c in _AMOUNTS if c not in o.columns})
    return o.withColumns({"gvkey": F.col("gid").cast("string"), "datadate": F.concat(F.col("fyear").cast("string"), F.lit("1231")), "indfmt": F.lit("INDL"), "datafmt": F.lit("STD"), "popsrc": F.lit("D")})


def price_index(spark, sf):
    """A monthly index over the months of the orders."""
    m = table(spark, sf, "orders").select(F.last_day("o_orderdate").alias("month_end")).distinct()
    return m.withColumn("cpi", (F.year("month_end") - 1990).cast("double") * 5 + F.month("month_end"))


_KEPT = "sic NOT LIKE '6%' AND consol = 'C' AND coalesce(sale, 0) >= 0 AND coalesce(assets, 0) >= 0 AND coalesce(teq, 0) >= 0 AND pddur BETWEEN 9 AND 15"
_P = lambda c: f"CASE WHEN {c} >= 0 THEN {c} END AS {c}"
_DIV = lambda a, b: f"(({a}) / nullif({b}, 0))"
_RATIOS = {
    "leverage": _DIV("coalesce(dltt, 0) + coalesce(dlc, 0)", "assets"), "roa": _DIV("oibdp", "at_lag"), "sale_growth": _DIV("sale - sale_lag", "sale_lag"), "tobinsq": _DIV("mv + coalesce(dltt, 0) + coalesce(dlc, 0)", "assets"), "market_to_book": _DIV("assets + mv - ceq", "assets"),
    "cash": _DIV("che", "assets"), "investment": _DIV("capx", "at_lag"), "intangible_assets": _DIV("coalesce(intan, 0)", "assets"), "tangibility_assets": _DIV("coalesce(ppegt, 0)", "assets"), "fixed_assets": _DIV("coalesce(ppent, 0)", "assets"), "net_working_capital": _DIV("wcap - che", "assets"),
    "gross_margin": _DIV("sale - cogs", "sale"), "profit_margin": _DIV("oiadp", "sale"), "free_cash_flow": _DIV("oibdp - xint - txt - capx", "at_lag"), "cash_flow": _DIV("coalesce(ib, 0) + dp + coalesce(xrd, 0)", "at_lag"), "interest_coverage": f"CASE WHEN xint > 0 AND oibdp < 0 THEN 0 ELSE {_DIV('oibdp', 'xint')} END",
    "net_debt_funding_rate": _DIV("coalesce(dltis, 0) - coalesce(dltr, 0) + coalesce(dlcch, 0)", "at_lag"), "net_equity_funding_rate": _DIV("coalesce(sstk, 0) - coalesce(prstkc, 0)", "at_lag"), "net_total_funding_rate": _DIV("coalesce(dltis, 0) - coalesce(dltr, 0) + coalesce(dlcch, 0) + coalesce(sstk, 0) - coalesce(prstkc, 0)", "at_lag"),
    "net_payout_at": _DIV("greatest(coalesce(dv, coalesce(dvc, 0) + coalesce(dvp, 0)), 0) + greatest(coalesce(prstkc, 0) - coalesce(sstk, 0), 0)", "assets"), "dividend_yield": _DIV("coalesce(dvc, 0) + coalesce(dvp, 0)", "mv"), "repo": _DIV("CASE WHEN prstkc IS NOT NULL THEN greatest(prstkc, 0) END", "mv_lag"), "oi_at": _DIV("oibdp", "assets"),
}
_PLAIN = {"acquisition": _DIV("aqc", "assets"), "randd_expenses": _DIV("coalesce(xrd, 0)", "at_lag"), "randd_real": "xrd / cpi * b", "csho_adj": "csho * coalesce(ajex, 1)", "employment": "emp", "log_at": "CASE WHEN assets > 0 THEN ln(assets) END", "log_sale": "CASE WHEN sale > 0 THEN ln(sale) END", "log_mv": "CASE WHEN mv > 0 THEN ln(mv) END", "market_value": "mv"}
_PLACES = {c: 4 for c in (*_RATIOS, *_PLAIN)} | {"randd_real": 1, "market_value": 2, "csho_adj": 2, "ww_index": 3, "sa_index": 3, "cf_volatility_rolling": 4}


@query(
    "fundamentals",
    f"""WITH {_RAW}, c AS (SELECT DISTINCT CAST(last_day(o_orderdate) AS DATE) AS m FROM orders), cpi AS (SELECT m, (year(m) - 1990) * 5.0 + month(m) AS cpi FROM c),
base AS (SELECT coalesce(max(CASE WHEN m = DATE '2004-12-31' THEN cpi END), median(cpi)) AS b FROM cpi),
f AS (SELECT gid, fyear, sic, ipodate, {", ".join(_P(c) for c in "assets intan sale ppent dltt dlc csho prcc_f xrd xint cogs che capx".split())}, coalesce(dp, 0) AS dp, ppegt, ajex, dv, dvc, dvp, prstkc, sstk, oibdp, oiadp, ceq, dltis, dltr, dlcch, aqc, wcap, ib, txt, emp
  FROM raw WHERE {_KEPT}),
l AS (SELECT f.*, cpi, b, csho * prcc_f AS mv, CASE WHEN assets / cpi * b <> 0 THEN assets / cpi * b END AS at_real, CASE WHEN sic = '0100.0' THEN '010' ELSE substr(sic, 1, 3) END AS s3, min(CASE WHEN prcc_f IS NOT NULL THEN fyear END) OVER (PARTITION BY gid) AS priced,
  lag(assets) OVER w AS at_lag, lag(sale) OVER w AS sale_lag, lag(csho * prcc_f) OVER w AS mv_lag FROM f LEFT JOIN cpi ON cpi.m = make_date(fyear, 12, 31), base WINDOW w AS (PARTITION BY gid ORDER BY fyear)),
g AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in (_RATIOS | _PLAIN).items())}, CASE WHEN gid % 6 = 0 OR priced IS NOT NULL THEN least(fyear - coalesce(CASE WHEN gid % 6 = 0 THEN 1989 END, priced), 37) END AS age FROM l),
i AS (SELECT *, avg(sale_growth) OVER (PARTITION BY fyear, s3) AS isg, CASE WHEN count(cash_flow) OVER v = 5 THEN stddev_samp(cash_flow) OVER v END AS cf_volatility_rolling, CASE WHEN at_real > 0 THEN least(ln(at_real), ln(4500)) END AS sz FROM g WINDOW v AS (PARTITION BY gid ORDER BY fyear ROWS 4 PRECEDING)),
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}, count({c}) AS n_{c}" for c in _RATIOS)} FROM i)
SELECT CAST(gid AS VARCHAR) AS gvkey, fyear AS data_year, s3 AS sic3, age AS firm_age, {", ".join(f"round(CASE WHEN {c} IS NULL OR n_{c} < 50 THEN {c} ELSE least(greatest({c}, lo_{c}), hi_{c}) END, 4) + 0.0 AS {c}" for c in _RATIOS)},
  {", ".join(f"round({c}, {_PLACES[c]}) + 0.0 AS {c}" for c in _PLAIN)}, round(cf_volatility_rolling, 4) + 0.0 AS cf_volatility_rolling,
  round(-0.091 * (ib + dp) / nullif(assets, 0) - 0.062 * CASE WHEN coalesce(dvc, 0) + coalesce(dvp, 0) > 0 THEN 1 ELSE 0 END + 0.021 * leverage - 0.044 * CASE WHEN assets > 0 THEN ln(assets) END + 0.102 * sale_growth - 0.035 * isg, 3) + 0.0 AS ww_index,
  round(-0.737 * sz + 0.043 * sz * sz - 0.04 * age, 3) + 0.0 AS sa_index FROM i, q""",
)
def _(spark, sf):
    got = A.fundamentals(statements(spark, sf), price_index(spark, sf), keep=["gvkey", "data_year", "sic3", "firm_age", *_PLACES])
    return got.select("gvkey", F.col("data_year").cast("long").alias("data_year"), "sic3", F.col("firm_age").cast("long").alias("firm_age"), *[(F.round(c, n) + 0.0).alias(c) for c, n in _PLACES.items()])


def raw_links(spark, sf):
    """Links of customers to 40 permanent ids, valid from a date that depends on the customer; some end, some stay open."""
    c, day = table(spark, sf, "customer"), lambda k: F.date_format(F.date_add(F.lit("1994-01-01").cast("date"), k.cast("int")), "yyyyMMdd")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("gvkey"), (k + 1000).cast("string").alias("lpermno"), (k % 40).cast("string").alias("lpermco"), F.concat(F.lit("C"), F.lpad((k % 200).cast("string"), 5, "0"), F.lit("10")).alias("cusip"),
        F.lit("3571").alias("sic"), day(k % 900).alias("linkdt"), F.when(k % 3 > 0, day(k % 900 + 1500)).alias("linkenddt"),
        F.when(k % 11 == 0, "NR").otherwise("LU").alias("linktype"), F.when(k % 13 == 0, "N").otherwise("P").alias("linkprim"),
    )


_LINKS = """links AS (SELECT c_custkey AS gvkey, c_custkey % 40 AS permco, 'C' || lpad(CAST(c_custkey % 200 AS VARCHAR), 5, '0') AS code, DATE '1994-01-01' + CAST(c_custkey % 900 AS INT) AS lo,
  CASE WHEN c_custkey % 3 > 0 THEN DATE '1994-01-01' + CAST(c_custkey % 900 + 1500 AS INT) ELSE DATE '2021-10-01' END AS hi FROM customer WHERE c_custkey % 11 > 0 AND c_custkey % 13 > 0)"""


@query("link_table", f"WITH {_LINKS} SELECT gvkey, permco, lo AS linkdt, hi AS linkenddt FROM links")
def _(spark, sf):
    return A.link_table(raw_links(spark, sf)).select("gvkey", "permco", "linkdt", "linkenddt")


@query("link_on_date", f"WITH {_LINKS}, {_RAW} SELECT l.permco, s.y AS data_year, s.gid AS gvkey FROM (SELECT gid, fyear AS y FROM raw WHERE {_KEPT}) s JOIN links l ON l.gvkey = s.gid AND make_date(s.y, 12, 31) BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY l.permco, s.y ORDER BY s.gid) = 1")
def _(spark, sf):
    facts = A.clean_fundamentals(statements(spark, sf))
    return A.link_on_date(facts, A.link_table(raw_links(spark, sf))).select("permco", F.col("data_year").cast("long").alias("data_year"), "gvkey")


_DEALS = f"""{_LINKS}, raw AS (SELECT o_orderkey AS ref, CAST(o_orderdate AS DATE) AS announced, 'C' || lpad(CAST(o_custkey % 200 AS VARCHAR), 5, '0') AS acq, 'C' || lpad(CAST(o_orderkey % 200 AS VARCHAR), 5, '0') AS tgt,
  o_totalprice AS deal_value, CAST(least(100, o_orderkey % 120) AS DOUBLE) AS pct, o_orderstatus, CAST(o_custkey % 3 <> o_orderkey % 3 AS INT) AS diversifying FROM orders WHERE o_totalprice > 400000 AND o_orderstatus IN ('F', 'O')),
k AS (SELECT DISTINCT code, permco, lo, hi FROM links),
deals AS (SELECT ref, t.permco AS permco_target, a.permco AS permco_acquiror, CAST(year(announced) - CASE WHEN month(announced) >= 6 THEN 0 ELSE 1 END AS BIGINT) AS deal_year, deal_value, pct, CAST(o_orderstatus = 'O' AS INT) AS failed, diversifying
  FROM raw JOIN k t ON t.code = tgt AND announced BETWEEN t.lo AND t.hi JOIN k a ON a.code = acq AND announced BETWEEN a.lo AND a.hi WHERE t.permco <> a.permco
  QUALIFY row_number() OVER (PARTITION BY permco_target, permco_acquiror, deal_year ORDER BY announced DESC, deal_value DESC) = 1)"""


def deals(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_totalprice") > 400000)
    code = lambda c: F.concat(F.lit("c"), F.lpad((F.col(c) % 200).cast("string"), 5, "0"), F.lit("99"))
    raw = o.select(
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("date_announced"), F.lit(None).cast("string").alias("date_effective"), code("o_orderkey").alias("target_cusip"), code("o_custkey").alias("acquiror_cusip"),
        F.when(F.col("o_orderstatus") == "F", " completed").when(F.col("o_orderstatus") == "O", "WITHDRAWN ").otherwise("Pending").alias("status"), F.col("o_totalprice").cast("string").alias("deal_value"),
        F.concat(F.lit("about "), (F.col("o_orderkey") % 120).cast("string"), F.lit("%")).alias("pct_acquired"), F.lit(None).cast("string").alias("pct_owned"), F.lit(None).cast("string").alias("pct_sought"),
        (F.col("o_custkey") % 3).cast("string").alias("acquiror_sic2"), (F.col("o_orderkey") % 3).cast("string").alias("target_sic2"), F.lit(None).cast("string").alias("acquiror_sic3"), F.lit("357").alias("target_sic3"),
    )
    return D.deal_panel(raw, A.link_table(raw_links(spark, sf)))


@query("deal_panel", f"WITH {_DEALS} SELECT permco_target, permco_acquiror, deal_year, round(deal_value, 2) AS deal_value, pct AS pct_acquired, failed, diversifying FROM deals")
def _(spark, sf):
    return deals(spark, sf).select("permco_target", "permco_acquiror", F.col("deal_year").cast("long").alias("deal_year"), F.round("deal_value", 2).alias("deal_value"), "pct_acquired", "failed", "diversifying")


@query(
    "deal_counts",
    f"""WITH {_DEALS}, r AS (SELECT permco_acquiror AS permco, 'a' AS role, * FROM deals UNION ALL SELECT permco_target, 't', * FROM deals)
SELECT permco, deal_year AS data_year, count(*) FILTER (role = 'a') AS n_deals_acquiror, count(*) FILTER (role = 't') AS n_deals_target, count(*) FILTER (role = 'a' AND failed = 1) AS n_failed_acquiror,
  round(coalesce(sum(deal_value) FILTER (role = 't'), 0), 2) AS deal_value_target, round(avg(pct) FILTER (role = 'a'), 4) AS mean_pct_acquired_acquiror FROM r GROUP BY 1, 2""",
)
def _(spark, sf):
    got = D.deal_counts(D.deal_roles(deals(spark, sf)))
    return got.select("permco", F.col("data_year").cast("long").alias("data_year"), "n_deals_acquiror", "n_deals_target", "n_failed_acquiror", F.round("deal_value_target", 2).alias("deal_value_target"), F.round("mean_pct_acquired_acquiror", 4).alias("mean_pct_acquired_acquiror"))
