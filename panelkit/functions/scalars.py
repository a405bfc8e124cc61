"""Scalar expressions of the construction steps; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column, fmt: str = "yyyyMMdd") -> Column:
    """A date, NULL where the text does not fit the format."""
    return F.try_to_date(c.cast("string"), fmt)


def fiscal_year(date: Column, first_month: int = 6) -> Column:
    """The date's year from first_month on, else the year before."""
    return F.when(F.month(date) >= first_month, F.year(date)).otherwise(F.year(date) - 1)


def month_end(date: Column) -> Column:
    return F.last_day(date)


def zero_pad(c: Column, width: int = 2) -> Column:
    """A code as text of fixed width with leading zeros."""
    return F.lpad(c.try_cast("int").cast("string"), width, "0")


def industry_code(c: Column, digits: int | None = None) -> Column:
    """An industry code as four characters: no decimals, leading zeros stripped, three digits padded on the left; or its prefix."""
    bare = F.regexp_replace(F.split(c.cast("string"), r"\.")[0], "^0+", "")
    four = F.when(F.length(bare) == 3, F.lpad(bare, 4, "0")).otherwise(bare)
    return F.substring(four, 1, digits) if digits else four


def percent(c: Column) -> Column:
    """The first number of a text like `about 12.5%`, clipped to 0 to 100."""
    number = F.regexp_extract(F.regexp_replace(c.cast("string"), "[,%]", ""), r"(-?\d+\.?\d*)", 1).try_cast("double")
    return clip(number, 0.0, 100.0)


def cusip6(c: Column) -> Column:
    return F.upper(F.substring(F.trim(c), 1, 6))


def status(c: Column) -> Column:
    return F.initcap(F.trim(c))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0 or either is NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """c within lo and hi; NULL stays NULL."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def sum_any(*cs: Column) -> Column:
    """The row-wise sum of the values that are there; NULL if none is."""
    return F.when(F.coalesce(*cs).isNotNull(), sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0)))


#: How many values hashed() has.
HASHES = 1 << 60


def hashed(*parts: Column, seed: int = 42) -> Column:
    """A whole number from 0 to HASHES - 1: the first 60 bits of the MD5 of the parts and the seed, joined by |."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def pair_key(a: Column, b: Column) -> Column:
    """The same struct for (a, b) and (b, a)."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def composite_key(*cs: Column, missing: str = "nan") -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit(missing)) for c in cs])


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def dummies(c: str, levels: list, drop_first: bool = True) -> dict[str, Column]:
    """One 0/1 column per level."""
    return {f"{c}_{v}": F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0) for v in (levels[1:] if drop_first else levels)}


def excluded_prefix(c: Column, prefixes: tuple[str, ...] = ("6", "49", "9")) -> Column:
    """True where the code begins with none of the prefixes (NULL codes pass)."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.coalesce(c.startswith(p), F.lit(False))
    return ~hit
