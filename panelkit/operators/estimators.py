"""Treatment-effect estimators: aggregation jobs with small solves on the driver."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .gram import FeResult, Fit, fe_many, fe_ols, independent, result_frame, time_index
from .group_time import changes, fit_cells, role_rows
from .stages import stage
from .windows import first_by


def did_table(df: DataFrame, outcomes: list[str], entity: str, time: str, treat: str = "post_treated", controls: list[str] | None = None, cov: str = "entity", alpha: float = 0.05) -> DataFrame:
    """One row per outcome and term, all outcomes in the same passes; a fit that fails leaves a row with its status instead of vanishing."""
    rows = []
    for y, fit in fe_many(df, [Fit(y, y, [treat, *(controls or [])], cov=cov) for y in outcomes], entity, time).items():
        if fit.status != "ok":
            rows.append({"outcome": y, "term": treat, "status": fit.status})
        else:
            rows += [{"outcome": y, "significant": r["p"] is not None and r["p"] < alpha} | r for r in fit.rows()]
    return result_frame(df.sparkSession, rows, "outcome string, significant boolean, ")


def significant_outcomes(table: DataFrame, term: str, alpha: float = 0.05) -> list[str]:
    """Outcomes whose coefficient on term has p below alpha: the gate before the costlier estimators."""
    return sorted(r["outcome"] for r in table.where((F.col("term") == term) & (F.col("p") < alpha)).select("outcome").distinct().collect())


def event_terms(df: DataFrame, k: str, treated: str, lo: int, hi: int, ref: int = -1) -> tuple[DataFrame, dict[str, int]]:
    """Dummies of event time for treated rows, all but the reference."""
    names = {f"k_{'m' if e < 0 else 'p'}{abs(e)}": e for e in range(lo, hi + 1) if e != ref}
    return df.withColumns({n: ((F.col(treated) == 1) & (F.coalesce(F.col(k) == e, F.lit(False)))).cast("double") for n, e in names.items()}), names


def event_study(df: DataFrame, y: str, entity: str, time: str, k: str, treated: str, lo: int, hi: int, ref: int = -1, controls: list[str] | None = None, cov: str = "entity") -> DataFrame:
    """k, coef, se and 95% band of each event time; the reference is 0."""
    d, names = event_terms(df, k, treated, lo, hi, ref)
    fit = fe_ols(d, y, [*names, *(controls or [])], entity, time, cov)
    rows = [(ref, 0.0, 0.0, 0.0, 0.0, "reference")]
    for r in fit.rows():
        if r["term"] in names:
            c, s = r["coef"], r["se"]
            rows.append((names[r["term"]], c, s, *((c - 1.96 * s, c + 1.96 * s) if c is not None else (None, None)), r["status"]))
    return df.sparkSession.createDataFrame(sorted(rows), "k int, coef double, se double, lo double, hi double, status string")


def _triple(df: DataFrame, specs: dict[str, str], post: str, treat: str) -> DataFrame:
    """df with post x z and treatment x z of each spec; a missing z is 0."""
    v = {s: F.coalesce(F.col(z).cast("double"), F.lit(0.0)) for s, z in specs.items()}
    return df.withColumns({f"post_x_z{s}": F.col(post) * x for s, x in v.items()} | {f"treat_x_z{s}": F.col(treat) * x for s, x in v.items()})


def triple_did(df: DataFrame, y: str, z: str, entity: str, time: str, post: str = "post", treat: str = "post_treated", controls: list[str] | None = None, cov: str = "entity") -> FeResult:
    """Adds post x z and treatment x z (the level of z is absorbed by the entity); a missing z is 0."""
    return fe_ols(_triple(df, {"": z}, post, treat), y, [treat, "post_x_z", "treat_x_z", *(controls or [])], entity, time, cov)


def group_effect(fit: FeResult, base: str = "treat", step: str = "treat_x_z") -> tuple[float, float]:
    """The effect in the group with z = 1, and its standard error, from both coefficients and their covariance."""
    i, j = fit.names.index(base), fit.names.index(step)
    return float(fit.beta[i] + fit.beta[j]), math.sqrt(max(0.0, fit.cov[i, i] + fit.cov[j, j] + 2 * fit.cov[i, j]))


def heterogeneity_specs(df: DataFrame, outcomes: list[str], specs: dict[str, str], entity: str, time: str, post: str = "post", treat: str = "post_treated", controls: list[str] | None = None, cov: str = "entity") -> DataFrame:
    """Triple differences for each (spec, outcome), all in the same passes, one table."""
    fits = {(s, y): Fit(f"{s}|{y}", y, [treat, f"post_x_z_{s}", f"treat_x_z_{s}", *(controls or [])], cov=cov) for s in specs for y in outcomes}
    got = fe_many(_triple(df, {f"_{s}": z for s, z in specs.items()}, post, treat), list(fits.values()), entity, time)
    plain = lambda s, term: term.removesuffix(f"_{s}") if term.startswith(("post_x_z_", "treat_x_z_")) else term
    rows = [{"spec": s, "outcome": y} | r | {"term": plain(s, r["term"])} for (s, y), f in fits.items() for r in got[f.key].rows()]
    return result_frame(df.sparkSession, rows, "spec string, outcome string, ")


def cohort_average(fit: FeResult, cells: dict[str, tuple[int, int]], sizes: dict[int, int], first: int, last: int, lo: int, hi: int, ref: int = -1, renormalise: bool = False) -> list[tuple[int, float, float, int]]:
    """(k, coef, se, n_cohorts): a fit's (cohort, k) cells weighted by cohort size; see sun_abraham."""
    at, rows = {cells[n]: i for i, n in enumerate(fit.names)}, []
    for k in range(lo, hi + 1):
        ok = [c for c in sizes if k != ref and first <= c + k <= last and (not renormalise or (c, k) in at)]
        total = sum(sizes[c] for c in ok)
        if not total or not any((c, k) in at for c in ok):
            continue
        w = np.array([sizes[c] / total for c in ok])
        b = np.array([fit.beta[at[c, k]] if (c, k) in at else 0.0 for c in ok])
        a = np.zeros(len(fit.names))
        for c, x in zip(ok, w, strict=True):
            if (c, k) in at:
                a[at[c, k]] = x
        spread = (np.diag(w) - np.outer(w, w)) / max(1, total - 1)
        rows.append((k, float(w @ b), float(math.sqrt(max(0.0, a @ fit.cov @ a + b @ spread @ b))), len(ok)))
    return rows


def sun_abraham(df: DataFrame, y: str, entity: str, time: str, g: str, lo: int, hi: int, ref: int = -1, cov: str = "twoway", renormalise: bool = False) -> DataFrame:
    """k, coef, se, n_cohorts: cohort-by-event-time effects, weighted by cohort size.

    Entities with one period and periods with one entity are left out. A cohort is eligible for k if its period lies
    in the data; an eligible cohort without an estimated cell keeps its weight with effect 0 unless renormalised.
    """
    d = df.select(entity, time, F.col(y).cast("double").alias("y"), F.coalesce(F.col(g), F.lit(0)).cast("long").alias("g")).dropna()
    many = d.groupBy(entity).agg(F.countDistinct(time).alias("n")).where("n >= 2").select(entity)
    d = d.join(many, entity, "left_semi")
    d = stage(d.join(d.groupBy(time).agg(F.countDistinct(entity).alias("n")).where("n >= 2").select(time), time, "left_semi"), "cohort-rows")
    sizes = {r["g"]: r["n"] for r in cohort_sizes(d, entity, "g").withColumnRenamed("w", "n").collect()}
    seen = [(r["g"], r["t"]) for r in d.select("g", F.col(time).cast("long").alias("t")).distinct().collect()]  # one row a cohort and period
    first, last = min((t for _, t in seen), default=0), max((t for _, t in seen), default=0)
    cells = sorted((c, t - c) for c, t in seen if c > 0 and lo <= t - c <= hi and t - c != ref)
    names = {f"g{a}_k{b}".replace("-", "m"): (a, b) for a, b in cells}
    number = F.create_map(*[v for i, (a, b) in enumerate(cells) for v in (F.lit(f"{a}|{b}"), F.lit(i))]) if cells else None
    own = F.concat_ws("|", F.col("g").cast("string"), (F.col(time).cast("long") - F.col("g")).cast("string"))
    d = d.withColumn("cell", F.element_at(number, own) if cells else F.lit(None).cast("int"))
    fit = fe_ols(d, "y", [], entity, time, cov, cells=("cell", list(names)))
    rows = [(ref, 0.0, 0.0, 0), *cohort_average(fit, names, sizes, first, last, lo, hi, ref, renormalise)]
    return df.sparkSession.createDataFrame(sorted(rows), "k int, coef double, se double, n_cohorts int")


def att_gt(df: DataFrame, y: str, entity: str, time: str, g: str, min_cohort: int = 1, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """g, t, k, att, n_treated, n_control: differences of cell means against units not yet or never treated.

    The base period is g - 1 from g on, the period before t earlier (varying base). A cell is identified if both groups
    have rows in both periods. All of it are joins of one small table of sums by (cohort, period).
    """
    d = df.select(entity, F.col(time).cast("long").alias("t"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(g), F.lit(0)).cast("long").alias("g")).dropna()
    d = first_by(d, [entity, "t"], ["g", "y"])
    big = d.groupBy("g").agg(F.countDistinct(entity).alias("n")).where((F.col("g") == 0) | (F.col("n") >= min_cohort)).select("g")
    cells = d.join(big, "g", "left_semi").groupBy("g", "t").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    now = cells.where("g > 0").select("g", "t", F.col("s").alias("s1"), F.col("n").alias("n1")).withColumn("k", F.col("t") - F.col("g"))
    if lo is not None:
        now = now.where(F.col("k") >= lo)
    if hi is not None:
        now = now.where(F.col("k") <= hi)
    now = now.withColumn("b", F.when(F.col("t") >= F.col("g"), F.col("g") - 1).otherwise(F.col("t") - 1))
    base = cells.where("g > 0").select("g", F.col("t").alias("b"), F.col("s").alias("s0"), F.col("n").alias("n0"))
    j = now.join(base, ["g", "b"])
    until = F.greatest("t", "b")

    def control(at: str, s: str, n: str) -> DataFrame:
        c = cells.select(F.col("g").alias("cg"), F.col("t").alias("ct"), F.col("s").alias("cs"), F.col("n").alias("cn"))
        ok = (F.col("ct") == F.col(at)) & ((F.col("cg") == 0) | (F.col("cg") > until)) & (F.col("cg") != F.col("g"))
        return j.join(c, ok).groupBy("g", "t").agg(F.sum("cs").alias(s), F.sum("cn").alias(n))

    out = j.join(control("t", "c1", "m1"), ["g", "t"]).join(control("b", "c0", "m0"), ["g", "t"])
    mean = lambda s, n: ratio(F.col(s), F.col(n))
    att = (mean("s1", "n1") - mean("s0", "n0")) - (mean("c1", "m1") - mean("c0", "m0"))
    return out.select("g", "t", "k", att.alias("att"), F.col("n1").alias("n_treated"), F.col("m1").alias("n_control"))


def cohort_sizes(df: DataFrame, entity: str, g: str) -> DataFrame:
    return df.where(F.col(g) > 0).groupBy(F.col(g).cast("long").alias("g")).agg(F.countDistinct(entity).alias("w"))


def att_dynamic(cells: DataFrame, sizes: DataFrame, lo: int, hi: int) -> DataFrame:
    """k, att, n_cohorts and the mean over k of 0 to hi: cohort effects weighted by cohort size."""
    x = cells.join(sizes, "g").where(F.col("k").between(lo, hi))
    by_k = x.groupBy("k").agg(ratio(F.sum(F.col("w") * F.col("att")), F.sum("w")).alias("att"), F.count("*").alias("n_cohorts"))
    overall = by_k.where("k >= 0").agg(F.avg("att").alias("overall"))
    return by_k.crossJoin(F.broadcast(overall))  # one row


def composition_ci(cells: DataFrame, sizes: DataFrame, lo: int, hi: int, draws: int = 30, seed: int = 42) -> DataFrame:
    """k, sd and percentile band over draws of the cohorts' sizes (multinomial): uncertainty of composition only."""
    w = sorted((r["g"], r["w"]) for r in sizes.collect())  # one row a cohort
    if not w:
        return cells.sparkSession.createDataFrame([], "k long, sd double, lo double, hi double")
    n = sum(x for _, x in w)
    drawn = np.random.default_rng(seed).multinomial(n, [x / n for _, x in w], draws)
    table = cells.sparkSession.createDataFrame([(b, int(g), int(c)) for b, row in enumerate(drawn) for (g, _), c in zip(w, row, strict=True)], "b int, g long, w long")
    each = cells.where(F.col("k").between(lo, hi)).join(table, "g").groupBy("b", "k").agg(ratio(F.sum(F.col("w") * F.col("att")), F.sum("w")).alias("att"))
    return each.groupBy("k").agg(F.stddev_samp("att").alias("sd"), F.percentile("att", F.lit(0.025)).alias("lo"), F.percentile("att", F.lit(0.975)).alias("hi"))


def att_gt_dr(df: DataFrame, y: str, entity: str, time: str, g: str, x: list[str], lo: int | None = None, hi: int | None = None, rounds: int = 25, trim: float = 0.995) -> DataFrame:
    """g, t, k, att, n_treated, n_control, method: doubly robust cells with covariates of the base period (see fit_cells).

    All cohorts and periods take part; group_time has the sample of roles with its trimming.
    """
    d = stage(role_rows(df, y, entity, time, {"all": g}, None, x, strict=False), "cells")
    z, cells = changes(d, x)
    cells = {n: (c, t) for n, (_, c, t) in cells.items() if (lo is None or t - c >= lo) and (hi is None or t - c <= hi)}
    schema = "g long, t long, k long, att double, n_treated long, n_control long, method string"
    if not cells:
        return df.sparkSession.createDataFrame([], schema)
    fits = fit_cells(stage(z, "changes"), len(x), rounds, trim)
    return df.sparkSession.createDataFrame([(c, t, t - c, *fits[n]) for n, (c, t) in cells.items() if n in fits], schema)


def bjs_effects(df: DataFrame, y: str, entity: str, time: str, treated: str, controls: list[str] | None = None, k: str = "k") -> DataFrame:
    """df's (entity, time, k, treated) with tau = y less the outcome imputed from untreated rows (entity and time effects, controls).

    Effects that no untreated row tells are 0, as are controls that were absorbed.
    """
    x = controls or []
    fit = fe_ols(df.where(F.col(treated) == 0), y, x, entity, time)
    lam = F.coalesce(F.element_at(F.create_map(*[v for t, e in fit.time_effects.items() for v in (F.lit(t), F.lit(e))]), F.col(time)), F.lit(0.0)) if fit.time_effects else F.lit(0.0)
    slope = sum((F.lit(float(b)) * F.col(n) for n, b in zip(fit.names, fit.beta, strict=True)), F.lit(0.0))
    d = df.dropna(subset=[y, entity, time, *x]).withColumn("__r", F.col(y) - lam - slope)
    alpha = d.where(F.col(treated) == 0).groupBy(entity).agg(F.avg("__r").alias("__a"))
    return d.join(alpha, entity, "left").select(entity, time, k, treated, (F.col("__r") - F.coalesce(F.col("__a"), F.lit(0.0))).alias("tau"))


def bjs_att(effects: DataFrame, treated: str, k: str = "k") -> DataFrame:
    """k, att, n: mean effects of treated rows by event time; untreated rows' means before treatment as diagnostics."""
    return effects.where(F.col(k).isNotNull()).groupBy(k, F.col(treated).cast("int").alias("treated")).agg(F.avg("tau").alias("att"), F.count("tau").alias("n"))


#: Donors of one block of rows, and treated units of one batch at least and at most, that a task holds together.
DONORS, FEW, UNITS = 2048, 64, 2048
#: Blocks of donors over which units settle within one task before the passes.
HELD = 16


def synthetic_control(df: DataFrame, y: str, entity: str, time: str, g: str, block: str | None = None, min_pre: int = 5, min_post: int = 3, pre_fit: int = 10, lo: int = -5, hi: int = 5, ridge: float = 1e-3, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """entity, k, gap, n_donors: each eligible treated unit against a non-negative mix of all never-treated units.

    Donors have values in all of the unit's periods and vary before treatment; with a block only those of the unit's
    block take part. Weights solve a ridge least-squares problem over the pre_fit periods before treatment, with
    weights falling with the distance to it, without negative ones; the mean gap of those periods is taken out. Units
    with fewer than two donors are left out.

    The problem is solved in its dual: with r the weighted residuals of the few fitted periods, donor i's weight is
    max(0, a_i'r) / ridge, and r solves r = b - sum_i a_i max(0, a_i'r) / ridge. A Newton step needs only sums over
    donors, so every step is one pass of the units' small vectors over all donors in blocks; nobody holds all donors,
    and none is left out. Units of a batch that share cohort and periods share the products with a block. Donors with
    the same values are one row with their number, and units with the same values and cohort are solved once. A unit
    starts where its steps over the first block of donors, and then over the first HELD, weighted up to all of them, have
    settled: that saves passes, all but one where the blocks are no more.
    """
    b_col = F.col(block).cast("string") if block else F.lit("all")
    c = df.select(F.col(entity).alias("e"), F.col(time).cast("long").alias("t"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(g), F.lit(0)).cast("long").alias("g"), b_col.alias("b")).dropna()
    c = c.groupBy("e", "b", "g", "t").agg(F.avg("y").alias("y"))
    path = F.sort_array(F.collect_list(F.struct("t", "y"))).alias("p")  # at most one pair a period
    c = stage(c.groupBy("e", "b", "g").agg(path, F.count_if(F.col("t") < F.col("g")).alias("pre"), F.count_if(F.col("t") >= F.col("g")).alias("post")), "scm")
    times = time_index(c.select(F.explode("p.t").alias("t")))
    at = {t: i for i, t in enumerate(times)}
    nt = len(times)
    empty = df.sparkSession.createDataFrame([], f"{entity} {dict(df.dtypes)[entity]}, k long, gap double, n_donors long")
    if not nt:
        return empty
    donors = stage(c.where("g = 0").groupBy("b", "p").agg(F.count("*").alias("m")), "paths")
    sizes = {r["b"]: r["n"] for r in donors.groupBy("b").agg(F.count("*").alias("n")).collect()}  # one row a block
    every = c.where((F.col("g") > 0) & (F.col("pre") >= min_pre) & (F.col("post") >= min_post)).select("b", "e", "g", "p")
    units = stage(every.groupBy("b", "g", "p").agg(F.min("e").cast("string").alias("u")), "alike")
    parts = F.create_map(*[v for k, n in sizes.items() for v in (F.lit(k), F.lit(-(-n // DONORS)))]) if sizes else None
    if parts is None:
        return empty
    donors = donors.withColumn("part", F.pmod(F.xxhash64("p"), F.element_at(parts, F.col("b"))).cast("int"))

    def matrix(paths) -> np.ndarray:
        out = np.full((len(paths), nt), np.nan)
        for row, p in zip(out, paths, strict=True):
            for x in p:
                row[at[x["t"]]] = x["y"]
        return out

    def pack(pdf):
        import pandas as pd

        return pd.DataFrame({"b": pdf["b"].iloc[:1], "part": pdf["part"].iloc[:1], "rows": [np.column_stack([matrix(pdf["p"]), pdf["m"]]).tobytes()]})

    n_blocks = sum(-(-n // DONORS) for n in sizes.values())
    blocks = stage(donors.repartition(min(n_blocks, 200), "b", "part").groupBy("b", "part").applyInPandas(pack, "b string, part int, rows binary"), "donors")

    def setting(own: np.ndarray, when: int):
        """(the unit's periods, those before treatment, fitted ones, roots of their weights)."""
        t = np.array(times)
        has = ~np.isnan(own)
        before = has & (t < when)
        fit = np.flatnonzero(before & (t >= when - pre_fit))
        dist = (when - t[fit]).astype(float)
        return has, before, fit, np.sqrt((1 - dist / dist.max()) ** 2 + 1e-6) if len(fit) else dist

    def usable(d: np.ndarray, has: np.ndarray, before: np.ndarray) -> np.ndarray:
        ok = ~np.isnan(d[:, :nt][:, has]).any(axis=1)
        sd = np.zeros(len(d))
        if before.sum() > 1:
            sd[ok] = d[np.ix_(ok, np.flatnonzero(before))].std(axis=1)
        return d[ok & (sd > 0)]

    def sums_of(rows: np.ndarray, fit: np.ndarray, w: np.ndarray, r: np.ndarray, final: np.ndarray | None = None) -> np.ndarray:
        """A row for each row of r: the gradient's, the Hessian's and the value's sums over donors, or (final: its periods) the synthetic path."""
        many, a = rows[:, -1], rows[:, fit] * w
        s = np.maximum(a @ r.T, 0)
        weighted = (s * many[:, None]).T / ridge
        if final is not None:
            return weighted @ rows[:, :-1][:, final]
        squares = (a[:, :, None] * a[:, None, :]).reshape(len(a), -1) * many[:, None]
        return np.column_stack([weighted @ a, (s > 0).T.astype(float) @ squares / ridge, np.einsum("ud,du->u", weighted, s)])

    def passed(state: DataFrame, final: bool) -> DataFrame:
        """Sums over all donors for each unit: at the state's r, of the gradient and Hessian, or of the synthetic path."""

        def work(batches):
            import pyarrow as pa

            sums: dict = {}
            for batch in batches:
                for d, us in zip(batch.column(0), batch.column(1), strict=True):
                    d = np.frombuffer(d.as_py(), float).reshape(-1, nt + 1)
                    alike: dict = {}
                    for x in us.as_py():
                        own = np.frombuffer(x["own"], float)
                        alike.setdefault((x["g"], np.isnan(own).tobytes()), (own, []))[1].append((x["u"], x["r"]))
                    for (g, _), (own, mine) in alike.items():
                        has, before, fit, w = setting(own, g)
                        rows = usable(d, has, before)
                        out = sums_of(rows, fit, w, np.array([r for _, r in mine]).reshape(len(mine), len(fit)), has if final else None)
                        n = int(rows[:, -1].sum())
                        for (u, _), v in zip(mine, out, strict=True):
                            if u in sums:
                                sums[u][0] += n
                                sums[u][1] += v
                            else:
                                sums[u] = [n, v.copy()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([v.tolist() for _, v in sums.values()], pa.list_(pa.float64()))], names=["u", "n", "v"])

        # a batch of units meets all blocks of donors in one task, one block after the other
        batch = state.withColumn("unit", batch_of).groupBy("b", "unit").agg(F.collect_list(F.struct("u", "g", "own", "r")).alias("units"))
        met = blocks.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1)))).repartition(n_tasks, "b", "unit").join(batch, ["b", "unit"])
        return met.select("rows", "units").mapInArrow(work, "u string, n long, v array<double>")

    def step_of(goal: np.ndarray, r: np.ndarray, last: np.ndarray, step: float, least: float, v: np.ndarray):
        """(r, last r, step, value, still) after a step, from the sums v at r."""
        p = len(goal)
        value = 0.5 * r @ r - goal @ r + 0.5 * v[-1]
        if step and value > least + 1e-12 * abs(least):  # too far: halfway back
            return 0.5 * (r + last), last, step / 2, least, bool(step > 1e-9)
        grad = r - goal + v[:p]
        move = -np.linalg.solve(np.eye(p) + v[p:-1].reshape(p, p), grad) if p else grad
        going = bool(np.abs(grad).max(initial=0) > tolerance * max(1.0, np.abs(goal).max(initial=0)))
        return r + move if going else r, r, 1.0, float(value), going

    def start(pdfs):
        for pdf in pdfs:
            own = matrix(pdf["p"])
            yield pdf.assign(own=[x.tobytes() for x in own], r=[(own[i][setting(own[i], g)[2]] * setting(own[i], g)[3]).tolist() for i, g in enumerate(pdf["g"])]).drop(columns="p")[["b", "u", "g", "own", "r"]]

    def settle(pdf, held):
        """Steps over the first block of donors, then over all that are held, each row standing for as many as the blocks hold for it."""
        first, held = list(pdf["r"]), held.sort_values("part")
        every_block = [np.frombuffer(x, float).reshape(-1, nt + 1) for x in held["rows"]]
        alike: dict = {}
        for i, (g, own) in enumerate(zip(pdf["g"], pdf["own"], strict=True)):
            alike.setdefault((g, np.isnan(np.frombuffer(own, float)).tobytes()), []).append(i)
        for some in [every_block[:1], every_block][: len(every_block)]:
            up = sizes[held["b"].iloc[0]] / sum(map(len, some))
            for (g, _), mine in alike.items():
                has, before, fit, w = setting(np.frombuffer(pdf["own"].iloc[mine[0]], float), g)
                rows = [usable(np.column_stack([d[:, :-1], d[:, -1] * up]), has, before) for d in some]
                now = {i: (np.array(first[i]), np.array(first[i]), 0.0, math.inf, True) for i in mine} if any(map(len, rows)) and len(fit) else {}
                for _ in range(rounds):
                    on = [i for i, x in now.items() if x[-1]]
                    if not on:
                        break
                    r = np.array([now[i][0] for i in on])
                    for i, v in zip(on, sum(sums_of(d, fit, w, r) for d in rows), strict=True):
                        now[i] = step_of(np.array(pdf["r"].iloc[i]), *now[i][:-1], v)
                for i, x in now.items():
                    first[i] = x[0]
        first = [np.asarray(x).tolist() for x in first]
        return pdf.assign(r=first, last=first, step=0.0, value=math.inf, still=True)[["b", "u", "g", "own", "r", "last", "step", "value", "still"]]

    schema = "b string, u string, g long, own binary, r array<double>, last array<double>, step double, value double, still boolean"
    begun = stage(units.mapInPandas(start, "b string, u string, g long, own binary, r array<double>"), "begun")
    n_units = begun.count()
    n_batches = max(1, min(-(-n_units // FEW), 64), -(-n_units // UNITS))
    n_tasks = 2 * n_batches * max(1, min(len(sizes), 8))
    batch_of = F.pmod(F.xxhash64("u"), F.lit(n_batches)).cast("int")
    held = blocks.where(F.col("part") < HELD).withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))
    state = stage(begun.withColumn("unit", batch_of).repartition(n_tasks, "b", "unit").groupBy("b", "unit").cogroup(held.repartition(n_tasks, "b", "unit").groupBy("b", "unit")).applyInPandas(lambda pdf, some: settle(pdf, some), schema), "dual")

    def newton(pdfs):
        for pdf in pdfs:
            new = []
            for x in pdf.itertuples(index=False):
                own = np.frombuffer(x.own, float)
                _, _, fit, w = setting(own, x.g)
                p = len(fit)
                r, last, step, value, still = step_of(own[fit] * w, np.array(x.r), np.array(x.last), x.step, x.value, np.zeros(p + p * p + 1) if x.v is None else np.array(x.v))
                new.append((r.tolist(), last.tolist(), step, value, still))
            r, last, step, value, still = (list(c) for c in zip(*new, strict=True)) if new else ([], [], [], [], [])
            yield pdf[["b", "u", "g", "own"]].assign(r=r, last=last, step=step, value=value, still=still)

    for _ in range(rounds):
        open_ = state.where("still")
        if open_.isEmpty():
            break
        moved = open_.drop("still").join(passed(open_, False), "u", "left").drop("n").mapInPandas(newton, schema)
        state = stage(moved.unionByName(state.where("not still")), "dual")

    def gaps(pdfs):
        import pandas as pd

        for pdf in pdfs:
            rows = []
            for x in pdf.itertuples(index=False):
                own = np.frombuffer(x.own, float)
                has, _, fit, _ = setting(own, x.g)
                t = np.array(times)[has]
                gap = own[has] - np.array(x.v)
                gap = gap - gap[np.isin(t, np.array(times)[fit])].mean()
                rows += [(x.u, int(k), float(v), int(x.n)) for k, v in zip(t - x.g, gap, strict=True) if lo <= k <= hi]
            yield pd.DataFrame(rows, columns=["u", "k", "gap", "n_donors"])

    out = stage(state.join(passed(state, True).where("n >= 2"), "u").mapInPandas(gaps, "u string, k long, gap double, n_donors long"), "gaps")
    return every.join(units, ["b", "g", "p"]).select(F.col("e").alias(entity), "u").join(out, "u").drop("u")


def nonnegative(q: np.ndarray, c: np.ndarray, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """argmin w'qw/2 - c'w over w >= 0 by coordinate descent (q positive definite): the primal, for checks."""
    w, d = np.zeros(len(c)), np.diag(q)
    grad = -c.copy()
    for _ in range(rounds):
        most = 0.0
        for i in range(len(c)):
            step = max(-w[i], -grad[i] / d[i])
            if step:
                w[i] += step
                grad += q[:, i] * step
                most = max(most, abs(step))
        if most < tolerance:
            break
    return w


def scm_att(gaps: DataFrame, entity: str, hi: int = 5) -> DataFrame:
    """k, att, n and the mean over k of 0 to hi."""
    by_k = gaps.groupBy("k").agg(F.avg("gap").alias("att"), F.count("*").alias("n"))
    post = gaps.where(F.col("k").between(0, hi)).agg(F.avg("gap").alias("overall"))
    return by_k.crossJoin(F.broadcast(post))  # one row


def dml_cate(df: DataFrame, y: str, w: str, x: list[str], entity: str, folds: int = 2, trees: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ate, se, lo, hi, n); per unit (entity, score, cate); per covariate (name, slope, weight, place).

    Forests for outcome and treatment are cross-fitted; the effect is the mean of the augmented scores. Unit effects
    are linear in x: the outcome's residuals regressed on the treatment's residuals times (1, x), by one cross product.
    A covariate's weight in the ranking is its slope times its deviation.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    xs = [f"x{i}" for i in range(len(x))]
    d = df.select(F.col(entity).alias("e"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"), *[F.col(c).cast("double").alias(n) for c, n in zip(x, xs, strict=True)]).dropna()
    d = stage(d.withColumn("fold", F.pmod(F.xxhash64("e", F.lit(seed)), F.lit(folds))), "cross-section")
    d = VectorAssembler(inputCols=xs, outputCol="features").transform(d)
    parts = []
    for k in range(folds):
        train, test = d.where(F.col("fold") != k), d.where(F.col("fold") == k)
        out = test
        for arm in (0, 1):
            out = RandomForestRegressor(labelCol="y", predictionCol=f"m{arm}", numTrees=trees, minInstancesPerNode=10, seed=seed).fit(train.where(F.col("w") == arm)).transform(out)
        p = RandomForestClassifier(labelCol="w", predictionCol="pc", rawPredictionCol="pr", probabilityCol="pp", numTrees=trees, minInstancesPerNode=10, seed=seed).fit(train)
        parts.append(p.transform(out).withColumn("ps", F.least(F.greatest(vector_to_array("pp")[1], F.lit(0.02)), F.lit(0.98))).select("e", "y", "w", *xs, "m0", "m1", "ps"))
    s = stage(reduce(lambda a, b: a.unionByName(b), parts), "cross-fitted")
    score = F.col("m1") - F.col("m0") + F.col("w") * (F.col("y") - F.col("m1")) / F.col("ps") - (1 - F.col("w")) * (F.col("y") - F.col("m0")) / (1 - F.col("ps"))
    rw = F.col("w") - F.col("ps")
    r = s.withColumns({"ry": F.col("y") - F.col("ps") * F.col("m1") - (1 - F.col("ps")) * F.col("m0"), "z": rw} | {f"z{i}": rw * F.col(c) for i, c in enumerate(xs)})
    z = ["z", *(f"z{i}" for i in range(len(xs)))]
    g = gram_of(r, [*z, "ry"])[1:, 1:]
    keep = [i for i in independent(g[:-1, :-1])]
    slope = np.zeros(len(z))
    if keep:
        slope[keep] = np.linalg.solve(g[np.ix_(keep, keep)], g[keep, -1])
    cate = sum((F.lit(float(b)) * F.col(c) for b, c in zip(slope[1:], xs, strict=True)), F.lit(float(slope[0])))
    sd = s.agg(*[F.stddev_samp(c).alias(c) for c in xs]).first()
    weights = sorted(((n, float(b), abs(float(b)) * float(sd[c] or 0)) for n, b, c in zip(x, slope[1:], xs, strict=True)), key=lambda v: (-v[2], v[0]))
    ranking = df.sparkSession.createDataFrame([(*v, i + 1) for i, v in enumerate(weights)], "name string, slope double, weight double, place int")
    unit = s.select(F.col("e").alias(entity), score.alias("score"), cate.alias("cate"))
    m = unit.agg(F.avg("score").alias("ate"), (F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
    return m.select("ate", "se", (F.col("ate") - 1.96 * F.col("se")).alias("lo"), (F.col("ate") + 1.96 * F.col("se")).alias("hi"), "n"), unit, ranking


def event_cross_section(df: DataFrame, y: str, x: list[str], entity: str, k: str, treated: str, post: tuple[int, int] = (1, 3)) -> DataFrame:
    """entity, x at k = -1, treated, and y's mean over the periods after: one row per unit with all of them."""
    before = first_by(df.where(F.col(k) == -1), [entity], [k, *x]).select(entity, treated, *x)
    after = df.where(F.col(k).between(*post)).groupBy(entity).agg(F.avg(y).alias("y_post"))
    return before.join(after, entity).dropna()


def gram_of(df: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X with a constant first, by one aggregate."""
    v = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    p = len(v)
    r = df.dropna(subset=columns).agg(*[F.sum(v[i] * v[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = r[f"g{i}_{j}"] or 0.0
    return out


