"""Time-ordered operators inside an entity, and deduplication by an explicit total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HASHES, hashed


def _order(*cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def shifts(df: DataFrame, entity: str, order: list, column: str, offsets: list[int]) -> DataFrame:
    """column moved by each offset: `<column>_prev<n>` for rows before, `<column>_next<n>` for rows after."""
    w = Window.partitionBy(entity).orderBy(*_order(*order))
    return df.withColumns({f"{column}_{'prev' if o > 0 else 'next'}{abs(o)}": F.lag(column, o).over(w) for o in offsets})


def row_lag(df: DataFrame, entity: str, time: str, columns: list[str], gap_aware: bool = False, tie: tuple = ()) -> DataFrame:
    """`<c>_lag`: the value of the row before; with gap_aware only if that row is one period earlier.

    Rows of one period are ordered by tie, then by the columns themselves, so the result is the same in every run.
    """
    w = Window.partitionBy(entity).orderBy(*_order(time, *tie, *columns))
    near = F.lag(time).over(w) == F.col(time) - 1
    return df.withColumns({f"{c}_lag": F.when(near, F.lag(c).over(w)) if gap_aware else F.lag(c).over(w) for c in columns})


def cumulative(df: DataFrame, entity: str, time: str, columns: dict[str, str]) -> DataFrame:
    """Running sums: new name to column. Rows of one period are added in the order of the columns."""
    w = Window.partitionBy(entity).orderBy(*_order(time, *columns.values())).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({k: F.sum(c).over(w) for k, c in columns.items()})


def forward_fill(df: DataFrame, entity: str, time: str, column: str, name: str | None = None) -> DataFrame:
    """The latest value up to each row; of one period's values the largest, NULLs first."""
    w = Window.partitionBy(entity).orderBy(*_order(time, column)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name or column, F.last(column, ignorenulls=True).over(w))


def rolling_std(df: DataFrame, entity: str, time: str, column: str, name: str, rows: int = 5) -> DataFrame:
    """The sample deviation of the last rows, NULL unless all of them hold a value. Rows of one period: by value."""
    w = Window.partitionBy(entity).orderBy(*_order(time, column)).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.when(F.count(column).over(w) == rows, F.stddev_samp(column).over(w)))


def average_rank_percent(value: str, *group: str) -> Column:
    """The average rank of ties over the group's size (of rows with a value)."""
    w, ties = Window.partitionBy(*group).orderBy(value), Window.partitionBy(*group, value)
    n = F.count(value).over(Window.partitionBy(*group))
    nulls = F.sum(F.col(value).isNull().cast("int")).over(Window.partitionBy(*group))
    rank = F.rank().over(w) - nulls + (F.count(F.lit(1)).over(ties) - 1) / 2
    return F.when(F.col(value).isNotNull(), rank / n)


def distinct_in_group(value: str, *group: str) -> Column:
    """Distinct values in the group, on each row; for groups of bounded size such as teams."""
    return F.size(F.collect_set(value).over(Window.partitionBy(*group)))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the given total order."""
    return top_by(df, keys, order, 1)


def top_by(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_order(*order))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def modal_value(df: DataFrame, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    """The most frequent value per key; of equal counts the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name or value))


def unit_sample(df: DataFrame, unit: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of n units, drawn by a seeded hash without replacement."""
    units = df.select(unit).distinct().orderBy(hashed(F.col(unit), seed=seed), unit).limit(n)
    return df.join(units, [unit], "left_semi")


#: Units of one cell of global_rank, about.
RANK_CELL = 20_000


def global_rank(units: DataFrame, unit: str, name: str, seed: int) -> DataFrame:
    """units (distinct) with their place, from 1, in the order of a seeded hash.

    Hashes are even, so equal steps of the hash cut the order into cells of about RANK_CELL units. Each cell is ranked
    by itself, and starts after the counts of those before it; only the cells' counts meet in one task.
    """
    cells = max(1, units.count() // RANK_CELL)
    x = units.withColumn("__h", hashed(F.col(unit), seed=seed))
    x = x.withColumn("__c", F.floor(F.col("__h") / F.lit(float(HASHES)) * cells).cast("long"))
    counts = x.groupBy("__c").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__c", before.alias("__s"))
    rank = F.row_number().over(Window.partitionBy("__c").orderBy("__h", unit))
    return x.withColumn("__r", rank).join(starts, "__c").withColumn(name, F.col("__s") + F.col("__r")).drop("__h", "__c", "__r", "__s")


def grid(df: DataFrame, entity: str, lo: Column, hi: Column, time: str = "data_year") -> DataFrame:
    """entity x every period from lo to hi, both aggregates over the entity's rows."""
    spans = df.groupBy(entity).agg(lo.alias("__lo"), hi.alias("__hi"))
    return spans.select(entity, F.explode(F.sequence("__lo", "__hi")).alias(time))
