"""Balance, completeness and collinearity diagnostics; each is one or two aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .quantiles import exact_quantiles, quantiles_by


def smd(df: DataFrame, treated: str, columns: list[str], least: int = 5) -> DataFrame:
    """variable, smd, m1, m0, n1, n0: standardised mean differences; NULL below `least` rows or without variation."""
    a = df.agg(*[f(F.when(F.col(treated) == v, F.col(c))).alias(f"{k}{v}_{i}") for i, c in enumerate(columns) for v in (0, 1) for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"{k}{v}_{i}").alias(f"{k}{v}") for v in (0, 1) for k in "mvn"]) for i, c in enumerate(columns)])
    x = a.select(F.explode(rows).alias("r")).select("r.*")
    sd = F.sqrt(0.5 * (F.col("v1") + F.col("v0")))
    ok = (F.col("n1") >= least) & (F.col("n0") >= least) & (sd > 0)
    return x.select("variable", F.when(ok, ratio(F.col("m1") - F.col("m0"), sd)).alias("smd"), "m1", "m0", "n1", "n0")


def window_balance(df: DataFrame, event: list[str], k: str, lo: int, hi: int) -> DataFrame:
    """n_events, n_unbalanced: events whose distinct event times are not the whole window. Null parts of an event's key count as a value."""
    n = df.groupBy(*event).agg(F.countDistinct(k).alias("n"))
    return n.agg(F.count("*").alias("n_events"), F.count_if(F.col("n") != hi - lo + 1).alias("n_unbalanced"))


def rows_per_k(df: DataFrame, k: str, treated: str) -> DataFrame:
    return df.groupBy(k).agg(F.count_if(F.col(treated) == 1).alias("n_treated"), F.count_if(F.col(treated) == 0).alias("n_control"))


def reuse_stats(pairs: DataFrame, control: str, by: list[str]) -> DataFrame:
    """n_controls, share_reused, max_reuse."""
    n = pairs.select(control, *by).distinct().groupBy(control).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_controls"), F.avg((F.col("n") > 1).cast("double")).alias("share_reused"), F.max("n").alias("max_reuse"))


def top_reused(pairs: DataFrame, control: str, by: list[str], n: int = 15) -> DataFrame:
    return pairs.select(control, *by).distinct().groupBy(control).agg(F.count("*").alias("n")).orderBy(F.desc("n"), control).limit(n)


def grid_completeness(df: DataFrame, entity: str, time: str) -> DataFrame:
    """n_entities, share_complete: entities with a row in each period of their span."""
    s = df.groupBy(entity).agg(F.countDistinct(time).alias("n"), (F.max(time) - F.min(time) + 1).alias("span"))
    return s.agg(F.count("*").alias("n_entities"), F.avg((F.col("n") == F.col("span")).cast("double")).alias("share_complete"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, out = 1.0, 1.0 / max(1e-300, 1 - (a + b) * x / (a + 1)), 0.0
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def welch(df: DataFrame, treated: str, columns: list[str]) -> DataFrame:
    """variable, m1, m0, diff, t, df, p of two samples with unequal variances."""
    rows = []
    for r in smd_moments(df, treated, columns).collect():
        v1, v0 = (r["v1"] or 0) / max(1, r["n1"]), (r["v0"] or 0) / max(1, r["n0"])
        if r["n1"] < 2 or r["n0"] < 2 or v1 + v0 <= 0:
            rows.append((r["variable"], r["m1"], r["m0"], None if r["m1"] is None or r["m0"] is None else r["m1"] - r["m0"], None, None, None))
            continue
        t = (r["m1"] - r["m0"]) / math.sqrt(v1 + v0)
        d = (v1 + v0) ** 2 / (v1 * v1 / (r["n1"] - 1) + v0 * v0 / (r["n0"] - 1))
        rows.append((r["variable"], r["m1"], r["m0"], r["m1"] - r["m0"], t, d, incomplete_beta(d / 2, 0.5, d / (d + t * t))))
    return df.sparkSession.createDataFrame(rows, "variable string, m1 double, m0 double, diff double, t double, df double, p double")


def smd_moments(df: DataFrame, treated: str, columns: list[str]) -> DataFrame:
    a = df.agg(*[f(F.when(F.col(treated) == v, F.col(c).cast("double"))).alias(f"{k}{v}_{i}") for i, c in enumerate(columns) for v in (0, 1) for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"{k}{v}_{i}").alias(f"{k}{v}") for v in (0, 1) for k in "mvn"]) for i, c in enumerate(columns)])
    return a.select(F.explode(rows).alias("r")).select("r.*")


def overview(df: DataFrame, entity: str, time: str, k: str, treated: str) -> DataFrame:
    """metric, value."""
    a = df.agg(
        F.count("*").cast("double").alias("rows"), F.countDistinct(entity).cast("double").alias("entities"), F.countDistinct(time).cast("double").alias("periods"),
        F.min(k).cast("double").alias("k_min"), F.max(k).cast("double").alias("k_max"), F.count_if(F.col(k) < 0).cast("double").alias("rows_pre"), F.count_if(F.col(k) >= 0).cast("double").alias("rows_post"),
        F.count_if(F.col(treated) == 1).cast("double").alias("rows_treated"), F.countDistinct(F.when(F.col(treated) == 1, F.col(entity))).cast("double").alias("entities_treated"),
        F.avg((F.col(treated) == 1).cast("double")).alias("share_treated"),
    )
    return a.unpivot([], a.columns, "metric", "value")


def baseline_table(df: DataFrame, treated: str, columns: list[str]) -> DataFrame:
    """variable, grp (all, treated, control), n, mean, median, sd."""
    groups = {"all": "true", "treated": f"`{treated}` = 1", "control": f"`{treated}` = 0"}
    keys = [(c, n) for c in columns for n in groups]
    value = {k: f"CASE WHEN {groups[k[1]]} THEN CAST(`{k[0]}` AS DOUBLE) END" for k in keys}
    a = df.agg(*[f(F.expr(value[k])).alias(f"{i}_{s}") for i, k in enumerate(keys) for s, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))]).first()
    q = exact_quantiles(df, [(str(i), value[k], [0.5]) for i, k in enumerate(keys)])
    rows = [(*k, a[f"{i}_n"], a[f"{i}_mean"], q[str(i)][0], a[f"{i}_sd"]) for i, k in enumerate(keys)]
    return df.sparkSession.createDataFrame(rows, "variable string, grp string, n long, mean double, median double, sd double")


def profile(df: DataFrame, by: str, column: str) -> DataFrame:
    """Moments, quantiles and shares of zeros and negatives of a column by group."""
    q = [0.01, 0.05, 0.5, 0.95, 0.99]
    a = df.groupBy(by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg((F.col(column) == 0).cast("double")).alias("zero_share"), F.avg((F.col(column) < 0).cast("double")).alias("negative_share"))
    b = quantiles_by(df, [by], column, q).withColumnRenamed(by, "__by")
    a = a.join(b, F.col(by).eqNullSafe(F.col("__by")), "left")
    return a.select(by, "n", "mean", "sd", "min", "max", *[F.col("q")[i].alias(f"p{round(x * 100):02d}") for i, x in enumerate(q)], "zero_share", "negative_share")


def collinearity(df: DataFrame, columns: list[str], entity: str, time: str, tolerance: float = 1e-10) -> DataFrame:
    """One row: rank, deficiency, least singular value and condition number of X (from X'X), equal and near-perfect pairs, entities and periods with variation."""
    from .estimators import gram_of

    d = df.dropna(subset=columns)
    g = gram_of(d, columns)[1:, 1:]
    norm = np.sqrt(np.maximum(np.diag(g), 1e-300))
    e = np.linalg.eigvalsh(g / np.outer(norm, norm))  # of columns of unit length, so that units do not matter
    s = np.sqrt(np.maximum(e, 0))
    rank = int((e > tolerance * max(e.max(), 1e-300)).sum())
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = d.agg(F.count("*").alias("n"), *[F.count_if(F.col(a).eqNullSafe(F.col(b))).alias(f"e{i}") for i, (a, b) in enumerate(pairs)], *[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    equal = sum(r[f"e{i}"] == r["n"] for i in range(len(pairs)))
    near = sum(r[f"c{i}"] is not None and abs(r[f"c{i}"]) > 0.999999 for i in range(len(pairs)))

    def moving(key: str) -> int:
        v = d.groupBy(key).agg(*[F.countDistinct(c).alias(c) for c in columns])
        return v.where(" or ".join(f"{c} > 1" for c in columns)).count()

    row = (r["n"], rank, len(columns) - rank, float(s.min()), float(s.max() / s.min()) if s.min() > 0 else None, int(equal), int(near), moving(entity), moving(time))
    return df.sparkSession.createDataFrame([row], "n long, rank int, deficiency int, least_singular double, condition double, equal_pairs int, near_pairs int, entities_varying long, periods_varying long")


def rule_flags(p: DataFrame, n_post: str | None = None) -> DataFrame:
    """profile's rows with flags: a list of the rules that are met, in words."""
    rules = [(F.col("n") < 500, "fewer than 500 rows"), (F.coalesce(F.col("sd"), F.lit(0.0)) == 0, "no variation"), (F.coalesce(F.try_divide("p99", "p50") > 50, F.lit(False)), "p99 over 50 times the median"), (F.coalesce(F.try_divide("max", "p99") > 5, F.lit(False)), "maximum over 5 times p99")]
    if n_post:
        rules.append((F.coalesce(F.col(n_post), F.lit(0)) == 0, "no treated rows after treatment"))
    return p.withColumn("flags", F.array_join(F.array_compact(F.array(*[F.when(c, t) for c, t in rules])), "; "))
