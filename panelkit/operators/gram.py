"""Two-way fixed-effects least squares by distributed cross products.

With z = [time dummies, x, y], entity effects are swept out by G = sum_i (sum_t zz' - s_i s_i' / n_i), where s_i is the
entity's sum: exact for unbalanced panels, one shuffle by entity, no iteration. Only G (a few dozen columns squared) and
cluster moments reach the driver, where a small system is solved. A second pass over the same rows gives cluster scores.

Many fits (outcomes, specifications, roles, placebos) share both passes: each entity's rows are there once, as wide rows,
and every fit takes its own columns and rows of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 8192
MAX_TIMES = 2000


@dataclass
class FeResult:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    nobs: int
    n_entities: int
    ssr: float
    tss_within: float
    tss: float
    absorbed: list[str] = field(default_factory=list)
    times: list = field(default_factory=list)
    time_effects: dict = field(default_factory=dict)
    status: str = "ok"
    effects: dict = field(default_factory=dict)

    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    @property
    def r2_within(self) -> float | None:
        """Share of the variation left after both effects that x explains."""
        return 1 - self.ssr / self.tss_within if self.tss_within > 0 else None

    @property
    def r2(self) -> float | None:
        """Share of all variation that x and the effects explain."""
        return 1 - self.ssr / self.tss if self.tss > 0 else None

    def rows(self) -> list[dict]:
        out = []
        for n, b, s in zip(self.names, self.beta, self.se(), strict=True):
            t = b / s if s > 0 else None
            out.append({"term": n, "coef": float(b), "se": float(s), "t": None if t is None else float(t), "p": None if t is None else math.erfc(abs(t) / math.sqrt(2)), "nobs": self.nobs, "n_entities": self.n_entities, "r2_within": self.r2_within, "r2": self.r2, "status": self.status})
        return out + [{"term": n, "coef": None, "se": None, "t": None, "p": None, "nobs": self.nobs, "n_entities": self.n_entities, "r2_within": self.r2_within, "r2": self.r2, "status": "absorbed"} for n in self.absorbed]


@dataclass
class Fit:
    """One regression of many over the same wide rows.

    use: a column; only rows where it is 1 take part. cell, cells: see fe_ols. impute: (treated, k, lo, hi) makes it a
    fit of rows with treated = 0, whose effects on all rows are summed by treated and k.
    """

    key: str
    y: str
    x: list[str] = field(default_factory=list)
    use: str | None = None
    cell: str | None = None
    cells: list[str] = field(default_factory=list)
    cov: str = "entity"
    impute: tuple[str, str, int, int] | None = None

    def needs(self) -> list[str]:
        """Columns that must hold a finite number."""
        return [self.y, *self.x, *([self.impute[0]] if self.impute else [])]


RESULT = "term string, coef double, se double, t double, p double, nobs long, n_entities long, r2_within double, r2 double, status string"


def result_frame(spark: SparkSession, rows: list[dict], extra: str = "") -> DataFrame:
    schema = extra + RESULT
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def time_index(d: DataFrame) -> list:
    times = sorted(r["t"] for r in d.select("t").distinct().limit(MAX_TIMES + 1).collect())
    if len(times) > MAX_TIMES:
        raise ValueError(f"more than {MAX_TIMES} periods")
    return times


def by_entity(d: DataFrame, times: list) -> DataFrame:
    """Rows with the period's number, whole entities together in each partition."""
    at = F.create_map(*[v for i, t in enumerate(times) for v in (F.lit(t), F.lit(i))])
    return d.withColumn("t", F.element_at(at, F.col("t"))).repartition("e").sortWithinPartitions("e", "t")


def entity_chunks(batches: Iterator, columns: list[str]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(start of each entity, columns) of runs of whole entities, about CHUNK rows each."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        part = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns}
        held = part if held is None else {c: np.concatenate([held[c], part[c]]) for c in columns}
        if len(held["e"]) < CHUNK:
            continue
        e = held["e"]
        cut = int(np.flatnonzero(e != e[-1])[-1]) + 1 if (e != e[-1]).any() else 0
        if cut:
            yield np.flatnonzero(np.r_[True, e[1:cut] != e[: cut - 1]]), {c: v[:cut] for c, v in held.items()}
            held = {c: v[cut:] for c, v in held.items()}
    if held is not None and len(held["e"]):
        e = held["e"]
        yield np.flatnonzero(np.r_[True, e[1:] != e[:-1]]), held


def demeaned(z: np.ndarray, starts: np.ndarray) -> np.ndarray:
    size = np.diff(np.r_[starts, len(z)])
    return z - np.repeat(np.add.reduceat(z, starts, axis=0) / size[:, None], size, axis=0)


def summed(rows: DataFrame, columns: list[str], size: int, work: Callable[[np.ndarray, dict], np.ndarray]) -> np.ndarray:
    """The sum over all chunks of work(starts, columns), an array of this size: added up in tasks, then by position."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size)
        for starts, cols in entity_chunks(batches, columns):
            total += work(starts, cols)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["pos", "value"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect():
        out[r["pos"]] = r["value"]
    return out


def independent(g: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """The columns, first come first kept, that are no combination of those before (by the sweep of g)."""
    a, keep = g.copy(), []
    scale = np.maximum(np.diag(g), 1e-300)
    for i in range(len(g)):
        if a[i, i] > tolerance * scale[i]:
            keep.append(i)
            a = a - np.outer(a[:, i], a[i]) / a[i, i]
    return keep


def wide_rows(df: DataFrame, fits: list[Fit], entity: str, time: str) -> tuple[DataFrame, dict[str, str]]:
    """e, t and each column of the fits once, as doubles, for rows that some fit uses; and the new names of the columns."""
    names = list(dict.fromkeys(c for f in fits for c in [*f.needs(), *([f.use] if f.use else []), *([f.cell] if f.cell else []), *([f.impute[1]] if f.impute else [])]))
    at = {c: f"v{i}" for i, c in enumerate(names)}
    d = df.select(F.col(entity).alias("e"), F.col(time).alias("t"), *[F.col(c).cast("double").alias(v) for c, v in at.items()]).dropna(subset=["e", "t"])
    finite = lambda v: F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    takes = [reduce(lambda a, b: a & b, [finite(at[c]) for c in f.needs()] + ([F.coalesce(F.col(at[f.use]) == 1, F.lit(False))] if f.use else [])) for f in fits]
    return d.where(reduce(lambda a, b: a | b, takes)), at


def taken(f: Fit, at: dict[str, str], c: dict[str, np.ndarray], untreated: bool = True) -> np.ndarray:
    """The rows of a chunk that a fit uses."""
    on = np.isfinite(c[at[f.y]])
    for x in f.needs()[1:]:
        on &= np.isfinite(c[at[x]])
    if f.use:
        on &= c[at[f.use]] == 1
    return on & (c[at[f.impute[0]]] == 0) if f.impute and untreated else on


def design(f: Fit, at: dict[str, str], c: dict[str, np.ndarray], on: np.ndarray, n_times: int) -> np.ndarray:
    """[time dummies, x, dummies of the cell, y] of the rows that are taken."""
    t, n = c["t"][on], int(on.sum())
    z = np.zeros((n, n_times + len(f.x) + len(f.cells) + 1))
    z[np.arange(n), t] = 1
    for i, x in enumerate(f.x):
        z[:, n_times + i] = c[at[x]][on]
    if f.cells:
        number = c[at[f.cell]][on]
        own = np.flatnonzero(~np.isnan(number))
        z[own, n_times + len(f.x) + number[own].astype(np.int64)] = 1
    z[:, -1] = c[at[f.y]][on]
    return z


def groups_of(e: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, e[1:] != e[:-1]]) if len(e) else np.zeros(0, np.int64)


def fe_many(df: DataFrame, fits: list[Fit], entity: str, time: str) -> dict[str, FeResult]:
    """All fits by key, each y on x with entity and time effects, by one shuffle and two passes in all.

    A fit leaves out its own incomplete rows only. One without rows, or whose system can't be solved, has a status.
    """
    d, at = wide_rows(df, fits, entity, time)
    times = time_index(d)
    nt = len(times)
    blank = lambda f, why: FeResult([], np.zeros(0), np.zeros((0, 0)), 0, 0, 0.0, 0.0, 0.0, [*f.x, *f.cells], [], {}, why)
    if nt == 0:
        return {f.key: blank(f, "no rows") for f in fits}
    rows, columns = by_entity(d, times).persist(), ["e", "t", *at.values()]
    width = [nt + len(f.x) + len(f.cells) + 1 for f in fits]
    starts_at = np.cumsum([0] + [p * p + 4 + nt for p in width])

    def gram(starts, c):
        e = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(c["e"])]))
        out = np.zeros(starts_at[-1])
        for f, p, i in zip(fits, width, starts_at[:-1], strict=True):
            on = taken(f, at, c)
            if on.any():
                z, groups = design(f, at, c, on, nt), groups_of(e[on])
                y, w = z[:, -1].copy(), demeaned(z, groups)
                out[i : i + p * p + 4 + nt] = np.concatenate([(w.T @ w).ravel(), [len(y), len(groups), y.sum(), (y * y).sum()], z[:, :nt].sum(axis=0)])
        return out

    try:
        got = summed(rows, columns, int(starts_at[-1]), gram)
        solved = {}
        for f, p, i in zip(fits, width, starts_at[:-1], strict=True):
            g, (n, entities, s1, s2), seen = got[i : i + p * p].reshape(p, p), got[i + p * p : i + p * p + 4], got[i + p * p + 4 : i + p * p + 4 + nt]
            if n == 0:
                continue
            base = int(np.flatnonzero(seen)[0])  # the first period that the fit has is the reference
            order = [j for j in range(p - 1) if j != base]
            keep = [order[j] for j in independent(g[np.ix_(order, order)])]
            try:
                inverse = np.linalg.inv(g[np.ix_(keep, keep)]) if keep else np.zeros((0, 0))
            except np.linalg.LinAlgError as x:
                solved[f.key] = str(x)
                continue
            beta = inverse @ g[keep, -1]
            only_time = [j for j in keep if j < nt]
            within = g[-1, -1] - (g[only_time, -1] @ np.linalg.solve(g[np.ix_(only_time, only_time)], g[only_time, -1]) if only_time else 0)
            solved[f.key] = (keep, inverse, beta, g[-1, -1] - g[keep, -1] @ beta, within, n, entities, s2 - s1 * s1 / n, seen)
        second = [f for f in fits if f.key in solved and not isinstance(solved[f.key], str)]
        sizes = [2 * (f.impute[3] - f.impute[2] + 1) * 2 if f.impute else (m := len(solved[f.key][0])) * m * 2 + nt * m for f in second]
        second_at = np.cumsum([0, *sizes])

        def meat(starts, c):
            e = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(c["e"])]))
            out = np.zeros(second_at[-1])
            for f, i in zip(second, second_at[:-1], strict=True):
                keep, _, beta, *_ = solved[f.key]
                on = taken(f, at, c, untreated=not f.impute)
                if not on.any() or not keep and not f.impute:
                    continue
                z, m = design(f, at, c, on, nt), len(keep)
                if f.impute:
                    _, k, lo, hi = f.impute
                    r, treated, k = z[:, -1] - z[:, keep] @ beta, c[at[f.impute[0]]][on] != 0, c[at[k]][on]
                    own = e[on]
                    count = np.bincount(own[~treated], minlength=len(starts))
                    alpha = np.bincount(own[~treated], r[~treated], len(starts)) / np.maximum(count, 1)
                    inside = (k >= lo) & (k <= hi)
                    place = np.where(treated, 1, 0)[inside] * (hi - lo + 1) + (k[inside] - lo).astype(np.int64)
                    cells = 2 * (hi - lo + 1)
                    out[i : i + 2 * cells] = np.r_[np.bincount(place, (r - alpha[own])[inside], cells), np.bincount(place, minlength=cells)]
                    continue
                z = demeaned(z, groups := groups_of(e[on]))
                score = z[:, keep] * (z[:, -1] - z[:, keep] @ beta)[:, None]
                per_entity, per_time = np.add.reduceat(score, groups, axis=0), np.zeros((nt, m))
                np.add.at(per_time, c["t"][on], score)
                out[i : i + 2 * m * m + nt * m] = np.concatenate([(per_entity.T @ per_entity).ravel(), (score.T @ score).ravel(), per_time.ravel()])
            return out

        moments = summed(rows, columns, int(second_at[-1]), meat) if second_at[-1] else np.zeros(0)
    finally:
        rows.unpersist()
    out = {f.key: blank(f, f"failed: {solved[f.key]}" if f.key in solved else "no rows") for f in fits}
    for f, i in zip(second, second_at[:-1], strict=True):
        keep, inverse, beta, ssr, within, n, entities, tss, seen = solved[f.key]
        m, v = len(keep), np.zeros((len(keep), len(keep)))
        effects = {}
        if f.impute:
            lo, span = f.impute[2], f.impute[3] - f.impute[2] + 1
            sums, counts = moments[i : i + 2 * span], moments[i + 2 * span : i + 4 * span]
            effects = {(w, lo + j): (float(sums[w * span + j]), int(counts[w * span + j])) for w in (0, 1) for j in range(span) if counts[w * span + j]}
        elif m:
            by_e, robust, by_t = moments[i : i + m * m].reshape(m, m), moments[i + m * m : i + 2 * m * m].reshape(m, m), moments[i + 2 * m * m : i + 2 * m * m + nt * m].reshape(nt, m)
            v = inverse @ {"entity": by_e, "robust": robust, "time": by_t.T @ by_t, "twoway": by_e + by_t.T @ by_t - robust}[f.cov] @ inverse
        mine = [j for j, c in enumerate(keep) if c >= nt]
        x = [*f.x, *f.cells]
        names = [x[keep[j] - nt] for j in mine]
        known = {times[c]: float(beta[j]) for j, c in enumerate(keep) if c < nt}
        lam = {t: known.get(t, 0.0) for j, t in enumerate(times) if seen[j]}
        out[f.key] = FeResult(names, beta[mine], v[np.ix_(mine, mine)], int(n), int(entities), float(max(ssr, 0)), float(within), float(tss), [c for c in x if c not in names], [t for j, t in enumerate(times) if seen[j]], lam, "ok", effects)
    return out


def fe_ols(df: DataFrame, y: str, x: list[str], entity: str, time: str, cov: str = "entity", dof: float = 1.0, cells: tuple[str, list[str]] | None = None) -> FeResult:
    """y on x with entity and time effects; cov: entity, time, twoway or robust; dof: a factor on the covariance.

    cells: a column with the number of each row's cell (NULL: none) and the cells' names; each cell is one more 0/1
    regressor, made inside the tasks, so that only its number is shuffled.
    Rows with a missing or infinite value go. Regressors that the effects or others absorb are listed, not estimated.
    """
    cell, names = cells or (None, [])
    fit = fe_many(df, [Fit("", y, x, None, cell, names, cov)], entity, time)[""]
    if fit.status.startswith("failed"):
        raise np.linalg.LinAlgError(fit.status)
    fit.cov = dof * fit.cov
    return fit
