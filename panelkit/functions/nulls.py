"""Missing values: the engine knows NULL only. NaN and infinities become NULL where data come in and after ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(c: Column | str) -> Column:
    """NULL for NaN and +-infinity."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def sum0(c: Column | str) -> Column:
    """A sum that is 0 where a group has no value at all."""
    return F.coalesce(F.sum(c), F.lit(0))


def isin_or_false(cond: Column) -> Column:
    """Two-valued logic: a comparison with NULL is false."""
    return F.coalesce(cond, F.lit(False))


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, checked: a key that occurs twice fails the job that reads it (one aggregate, no extra collect)."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ok = F.when(n > 1, F.raise_error(F.concat(F.lit(f"key {keys} is not unique: "), F.to_json(F.struct(*keys)))).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("__ok", ok).where("__ok").drop("__ok")


def fill_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """0 for NULL in columns that are counts or sums; means are never filled."""
    return df.fillna(0, [c for c in columns if c in df.columns])


def coerce_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Ids as bigint; rows with an id that is no number go."""
    for c in columns:
        df = df.withColumn(c, F.col(c).try_cast("bigint"))
    return df.dropna(subset=list(columns))


def null_out_negatives(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns if c in df.columns})


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def first_existing(df: DataFrame, *candidates: str) -> str | None:
    """The first candidate that is a column of df."""
    return next((c for c in candidates if c in df.columns), None)
