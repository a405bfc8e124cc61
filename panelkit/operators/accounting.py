"""Accounting ratios, winsorising, and links between accounting and market identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import isin_or_false, keep_columns, nan_to_null, null_out_negatives
from ..functions.scalars import clip, excluded_prefix, fiscal_year, industry_code, parse_date, ratio, sum_any
from .quantiles import counted_quantiles
from .stages import dealt, stage
from .windows import first_by, rolling_std, row_lag

#: Statement items of which a negative amount is an error.
NON_NEGATIVE = ["at", "intan", "sale", "mkvalt", "ppent", "dltt", "dlc", "csho", "prcc_f", "xrd", "xad", "xsga", "xlr", "xint", "cogs", "che", "capx"]
#: Items whose absence means none.
ZERO_IF_MISSING = ["dp", "txdb", "re"]
#: Ratios that are winsorised, and all that may hold an infinity.
WINSORISED = ["leverage", "roa", "sale_growth", "tobinsq", "market_to_book", "cash", "investment", "intangible_assets", "tangibility_assets", "fixed_assets", "net_working_capital", "gross_margin", "profit_margin", "free_cash_flow", "cash_flow", "interest_coverage", "net_debt_funding_rate", "net_equity_funding_rate", "net_total_funding_rate", "net_payout_at", "dividend_yield", "repo", "oi_at"]
RATIOS = [*WINSORISED, "acquisition", "randd_expenses"]


def c0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def clean_fundamentals(raw: DataFrame) -> DataFrame:
    """Typed firm-years of standard-format statements of non-financial firms, the latest per (gvkey, fyear); dealt by gvkey, for all that follows by firm."""
    x = raw.withColumn("datadate", parse_date(F.col("datadate"))).withColumn("sic", F.col("sic").cast("string"))
    x = x.where(excluded_prefix(F.col("sic")))
    x = x.where((F.col("indfmt") == "INDL") & (F.col("datafmt") == "STD") & (F.col("popsrc") == "D") & (F.col("consol") == "C"))
    for c in ("sale", "at", "teq"):
        x = x.where(~isin_or_false(F.col(c) < 0))
    x = x.withColumn("data_year", fiscal_year(F.col("datadate"))).where(F.col("pddur").between(9, 15))
    x = first_by(dealt(x.where(F.col("gvkey").isNotNull()), "gvkey"), ["gvkey", "fyear"], [F.desc("datadate"), F.desc_nulls_last("at")])
    x = null_out_negatives(x, NON_NEGATIVE).fillna(0.0, [c for c in ZERO_IF_MISSING if c in x.columns])
    return x.withColumns({f"sic{n}": industry_code(F.col("sic"), n) for n in (2, 3, 4)})


def deflate(x: DataFrame, cpi: DataFrame, base: str = "2004-12-31") -> DataFrame:
    """at_real and randd_real in prices of the base month; without the base month, of the median."""
    level = cpi.agg(F.coalesce(F.max(F.when(F.col("month_end") == F.lit(base).cast("date"), F.col("cpi"))), F.percentile("cpi", F.lit(0.5))).alias("__base"))
    j = x.withColumn("month_end", F.last_day("datadate")).join(F.broadcast(cpi), "month_end", "left").crossJoin(F.broadcast(level))  # one row a month, and one row
    real = lambda c: ratio(F.col(c), F.col("cpi")) * F.col("__base")
    at_real = real("at")
    return j.withColumn("at_real", F.when(at_real != 0, at_real)).withColumn("randd_real", real("xrd")).drop("__base", "month_end", "cpi")


def fundamentals(raw: DataFrame, cpi: DataFrame, winsorised: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Firm-years with ratios, financing-constraint indices and rolling cash-flow volatility; infinities become NULL.

    Lags are those of the statement before, by date. The volatility is of the ratios before they are winsorised. keep:
    the columns that are wanted; others are neither written nor winsorised.
    """
    x = deflate(clean_fundamentals(raw), cpi)
    x = x.withColumns({"market_value": F.col("csho") * F.col("prcc_f"), "csho_adj": F.col("csho") * F.coalesce(F.col("ajex"), F.lit(1.0))})
    x = row_lag(x, "gvkey", "datadate", ["at", "sale", "ppent", "dltt", "dlc", "market_value"], tie=("fyear",))
    x = x.withColumns(
        {
            "dividends": F.greatest(F.coalesce(F.col("dv"), c0("dvc") + c0("dvp")), F.lit(0.0)),
            "repurchases": clip(F.col("prstkc"), 0.0),
            "net_repurchases": F.greatest(c0("prstkc") - c0("sstk"), F.lit(0.0)),
        }
    )
    at, lag = F.col("at"), F.col("at_lag")
    debt = c0("dltt") + c0("dlc")
    x = x.withColumns(
        {
            "payout": F.col("dividends") + F.col("repurchases"), "employment": F.col("emp") if "emp" in x.columns else F.lit(None).cast("double"),
            "net_payout_at": ratio(F.col("dividends") + F.col("net_repurchases"), at),
            "dividend_yield": ratio(c0("dvc") + c0("dvp"), F.col("market_value")),
            "repo": ratio(F.col("repurchases"), F.col("market_value_lag")),
            "log_at": F.ln("at"), "log_sale": F.ln("sale"), "log_mv": F.ln("market_value"),
            "roa": ratio(F.col("oibdp"), lag), "oi_at": ratio(F.col("oibdp"), at),
            "gross_margin": ratio(F.col("sale") - F.col("cogs"), F.col("sale")), "profit_margin": ratio(F.col("oiadp"), F.col("sale")),
            "sale_growth": ratio(F.col("sale") - F.col("sale_lag"), F.col("sale_lag")),
            "tobinsq": ratio(F.col("market_value") + debt, at), "market_to_book": ratio(at + F.col("market_value") - F.col("ceq"), at),
            "leverage": ratio(debt, at),
            "net_debt_funding_rate": ratio(c0("dltis") - c0("dltr") + c0("dlcch"), lag), "net_equity_funding_rate": ratio(c0("sstk") - c0("prstkc"), lag),
            "cash": ratio(F.col("che"), at),
            "interest_coverage": F.when((F.col("xint") > 0) & (F.col("oibdp") < 0), 0.0).otherwise(ratio(F.col("oibdp"), F.col("xint"))),
            "investment": ratio(F.col("capx"), lag), "acquisition": ratio(F.col("aqc"), at), "randd_expenses": ratio(c0("xrd"), lag),
            "intangible_assets": ratio(c0("intan"), at), "tangibility_assets": ratio(c0("ppegt"), at), "fixed_assets": ratio(c0("ppent"), at),
            "net_working_capital": ratio(F.col("wcap") - F.col("che"), at),
            "cash_flow": ratio(c0("ib") + F.col("dp") + c0("xrd"), lag),
            "free_cash_flow": ratio(F.col("oibdp") - F.col("xint") - F.col("txt") - F.col("capx"), lag),
        }
    )
    x = x.withColumn("net_total_funding_rate", sum_any(F.col("net_debt_funding_rate"), F.col("net_equity_funding_rate")))
    x = financing_constraints(x)
    x = rolling_std(x, "gvkey", "data_year", "cash_flow", "cf_volatility_rolling", 5)
    x = x.withColumns({c: nan_to_null(c) for c in [*RATIOS, "ww_index", "sa_index"]})
    x = keep_columns(x, keep) if keep else x
    return winsorize(stage(x, "fundamentals"), [c for c in WINSORISED if c in x.columns], written=True) if winsorised else x


def financing_constraints(x: DataFrame) -> DataFrame:
    """ww_index and sa_index. Industry growth is the mean of (year, sic3); age counts from the first public or priced year."""
    growth = x.where(F.col("data_year").isNotNull() & F.col("sic3").isNotNull()).groupBy("data_year", "sic3").agg(F.avg("sale_growth").alias("isg"))
    priced = F.min(F.when(F.col("prcc_f").isNotNull(), F.col("data_year"))).over(Window.partitionBy("gvkey"))  # a firm has one row a year
    x = x.join(F.broadcast(growth), ["data_year", "sic3"], "left").withColumn("__first", F.when(F.col("gvkey").isNotNull(), priced))  # one row an industry and year
    cf = ratio(F.col("ib") + F.col("dp"), F.col("at"))
    pays = (c0("dvc") + c0("dvp") > 0).cast("double")
    age = clip((F.col("data_year") - F.coalesce(F.year(parse_date(F.col("ipodate"))), F.col("__first"))).cast("double"), None, 37.0)
    size = clip(F.ln("at_real"), None, 8.411832675758411)  # ln 4500
    ww = -0.091 * cf - 0.062 * pays + 0.021 * F.col("leverage") - 0.044 * F.ln("at") + 0.102 * F.col("sale_growth") - 0.035 * F.col("isg")
    return x.withColumns({"ww_index": ww, "firm_age": age, "size_real": size, "sa_index": -0.737 * size + 0.043 * size * size - 0.040 * age}).drop("__first")


def winsorize(df: DataFrame, columns: list[str], lo: float = 0.01, hi: float = 0.99, min_n: int = 50, written: bool = False) -> DataFrame:
    """Clips each column at its sample quantiles; columns with fewer than min_n values stay as they are. written: df is a stage."""
    q, n = counted_quantiles(df, [(c, f"`{c}`", [lo, hi]) for c in columns], written)
    return df.withColumns({c: clip(F.col(c), *q[c]) for c in columns if n[c] >= max(min_n, 1)})


def link_table(raw: DataFrame, open_end: str = "2021-10-01") -> DataFrame:
    """Usable links: types LU and LC, primary P and C, an open end filled, numeric ids, distinct."""
    x = raw.where(F.col("linktype").isin("LU", "LC") & F.col("linkprim").isin("P", "C"))
    x = x.withColumns({"linkdt": parse_date(F.col("linkdt")), "linkenddt": F.coalesce(parse_date(F.col("linkenddt")), F.lit(open_end).cast("date"))})
    x = x.withColumns({"gvkey": F.col("gvkey").try_cast("bigint"), "permco": F.col("lpermco").try_cast("bigint"), "permno": F.col("lpermno").try_cast("bigint")})
    x = x.withColumns({"sic2": industry_code(F.col("sic"), 2), "sic3": industry_code(F.col("sic"), 3)})
    return x.dropna(subset=["gvkey", "permco"]).select("gvkey", "permco", "permno", "cusip", "sic", "sic2", "sic3", "linkdt", "linkenddt").distinct()


def link_on_date(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Facts with the permco that their gvkey is linked to at datadate; one row per (permco, data_year), the latest statement."""
    from .joins import interval_join

    x = interval_join(facts.withColumn("gvkey", F.col("gvkey").try_cast("bigint")), links, "gvkey", "datadate", "linkdt", "linkenddt")
    return first_by(x, ["permco", "data_year"], [F.desc("datadate"), F.col("gvkey")])


def industry_mean(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by)))
