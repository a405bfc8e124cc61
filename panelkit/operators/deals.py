"""Deals between two linked parties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cusip6, fiscal_year, parse_date, percent, status
from .joins import two_sided_link
from .windows import first_by


def deal_panel(raw: DataFrame, links: DataFrame, date_format: str = "MM/dd/yyyy") -> DataFrame:
    """One row per (target, acquiror, year): the last announced of completed or withdrawn deals whose parties are linked at that date.

    diversifying is NULL where an industry is missing; a missing code never links.
    """
    x = raw.withColumns(
        {
            "announced": parse_date(F.col("date_announced"), date_format), "effective": parse_date(F.col("date_effective"), date_format),
            "target": cusip6(F.col("target_cusip")), "acquiror": cusip6(F.col("acquiror_cusip")), "deal_status": status(F.col("status")),
            "deal_value": F.regexp_replace(F.col("deal_value").cast("string"), ",", "").try_cast("double"),
            "pct_acquired": percent(F.col("pct_acquired")), "pct_owned": percent(F.col("pct_owned")), "pct_sought": percent(F.col("pct_sought")),
        }
    )
    x = x.where(F.col("deal_status").isin("Completed", "Withdrawn"))
    x = x.withColumns(
        {
            "deal_year": fiscal_year(F.col("announced")), "failed": (F.col("deal_status") == "Withdrawn").cast("int"),
            "diversifying": (F.col("acquiror_sic2") != F.col("target_sic2")).cast("int"), "diversifying3": (F.col("acquiror_sic3") != F.col("target_sic3")).cast("int"),
        }
    )
    k = links.withColumn("code", cusip6(F.col("cusip"))).where(F.col("code").isNotNull()).select("code", "permco", "linkdt", "linkenddt").distinct()
    both = two_sided_link(x, k, "announced", "target", "acquiror", "code", "permco", "linkdt", "linkenddt")
    return first_by(both, ["permco_target", "permco_acquiror", "deal_year"], [F.desc("announced"), F.desc_nulls_last("deal_value")])


def deal_roles(deals: DataFrame, target: str = "permco_target", acquiror: str = "permco_acquiror", carry: list[str] | None = None) -> DataFrame:
    """Two rows per deal, one for each party: permco, role, ma_other_party and what is carried. One scan of the deals."""
    carry = carry or [c for c in deals.columns if c not in (target, acquiror)]
    side = lambda a, b, role: F.struct(F.col(a).alias("permco"), F.lit(role).alias("role"), F.col(b).alias("ma_other_party"))
    return deals.select(F.explode(F.array(side(acquiror, target, "Acquiror"), side(target, acquiror, "Target"))).alias("s"), *carry).select("s.*", *carry)


def deal_counts(roles: DataFrame, year: str = "deal_year") -> DataFrame:
    """permco, year and per role: deals, failed deals, summed value, mean share acquired."""
    return roles.groupBy("permco", F.col(year).alias("data_year")).agg(
        *[
            a
            for role in ("acquiror", "target")
            for is_role in [F.lower("role") == role]
            for a in (
                F.sum(is_role.cast("int")).alias(f"n_deals_{role}"),
                F.sum((is_role & (F.col("failed") == 1)).cast("int")).alias(f"n_failed_{role}"),
                F.coalesce(F.sum(F.when(is_role, F.col("deal_value"))), F.lit(0.0)).alias(f"deal_value_{role}"),
                F.avg(F.when(is_role, F.col("pct_acquired"))).alias(f"mean_pct_acquired_{role}"),
            )
        ]
    )
