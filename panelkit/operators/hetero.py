"""Baseline splits for heterogeneous effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .quantiles import exact_quantiles
from .windows import average_rank_percent, distinct_in_group, first_by


def baseline_z(df: DataFrame, entity: str, k: str, column: str, name: str, at: int = -1) -> DataFrame:
    """df with the entity's value at k = at on all its rows."""
    b = first_by(df.where((F.col(k) == at) & F.col(column).isNotNull()), [entity], [k, column]).select(entity, F.col(column).alias(name))
    return df.join(b, entity, "left")


def ratio_z(df: DataFrame, num: str, den: str, name: str, den_is_log: bool = False) -> DataFrame:
    return df.withColumn(name, ratio(F.col(num), F.exp(den) if den_is_log else F.col(den)))


def binned(df: DataFrame, treated: str, bins: list[tuple[str, int, str]]) -> DataFrame:
    """df with bins 0 to n-1 for each (column, n, name), by cut points of treated rows.

    Right-closed, lowest included, equal cuts merged, outside NULL. The cut points of all are found together.
    """
    q = exact_quantiles(df, [(name, f"CASE WHEN `{treated}` = 1 THEN `{c}` END", [i / n for i in range(n + 1)]) for c, n, name in bins])
    new = {}
    for column, _, name in bins:
        edges = sorted({v for v in q[name] if v is not None})
        c, out = F.col(column), F.lit(None).cast("int")
        for i in range(len(edges) - 1, 0, -1):
            lo = (c >= edges[0]) if i == 1 else (c > edges[i - 1])
            out = F.when(lo & (c <= edges[i]), i - 1).otherwise(out)
        new[name] = out
    return df.withColumns(new)


def quantile_z(df: DataFrame, column: str, treated: str, n: int, name: str) -> DataFrame:
    return binned(df, treated, [(column, n, name)])


def all_z(df: DataFrame, entity: str, k: str, treated: str, size: str, deal: str | None = None, cap: str | None = None, bins: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """Baseline size, and deal value over market value, each continuous and in 2, 3 and 5 bins."""
    x = baseline_z(df, entity, k, size, "z_size")
    names = ["z_size"]
    if deal and cap:
        x = baseline_z(ratio_z(x, deal, cap, "__z"), entity, k, "__z", "z_deal").drop("__z")
        names.append("z_deal")
    return binned(x, treated, [(z, n, f"{z}_q{n}") for z in names for n in bins])


def within_firm_upper_half(df: DataFrame, entity: str, firm: str, k: str, value: str, name: str, least: int = 2) -> DataFrame:
    """1 for entities in the upper half of their firm's ranking before treatment, 0 below, NULL in firms of fewer entities."""
    b = first_by(df.where(F.col(k) == -1), [entity], [k, F.col(firm)]).select(entity, firm, value)
    b = b.withColumn("__n", distinct_in_group(entity, firm)).withColumn("__p", average_rank_percent(value, firm)).where(F.col("__n") >= least)
    return df.join(b.select(entity, (F.col("__p") >= 0.5).cast("int").alias(name)), entity, "left")
