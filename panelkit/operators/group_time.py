"""Effects by cohort and period for several roles at once: the sample, its identified cells, and estimators of a cell.

A role (target, acquirer, ...) has a column with the first period in which a unit was exposed in it. All roles go
through the same passes, told apart by a column; what reaches the driver is a few numbers a cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import nan_to_null
from ..functions.scalars import ratio
from ..sources.files import Parameters
from .stages import dealt, stage
from .windows import first_by


def role_rows(df: DataFrame, y: str, entity: str, time: str, roles: dict[str, str], overall: str | None, x: list[str], strict: bool = True) -> DataFrame:
    """role, e, t, y, g, x0..: complete rows of each role, one per unit and period; g is 0 for units never exposed in it.

    roles: the cohort column of each role. Strict: a role's rows are those of units first exposed in this role (its
    cohort is the overall one) and of units that are never exposed at all; without it, units exposed in another role
    only are controls. A period that occurs twice in a unit keeps the row with the least values.
    """
    own = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).cast("long").alias("g")) for r, c in roles.items()]))
    base = df.select(F.col(entity).alias("e"), F.col(time).cast("long").alias("t"), nan_to_null(F.col(y).cast("double")).alias("y"), *[nan_to_null(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(x)], F.col(overall).cast("long").alias("any") if overall else F.lit(None).cast("long").alias("any"), own.alias("s"))
    d = base.select("s.role", "e", "t", "y", *(f"x{i}" for i in range(len(x))), "any", "s.g").dropna(subset=["e", "t"])
    d = d.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in ("g", "any")})
    if strict:
        if not overall:
            raise ValueError("strict roles need the overall cohort")
        ok = F.coalesce(F.col("g") == F.col("any"), F.lit(False)) | F.col("any").isNull()
        d = d.join(d.where(ok).select("role", "e").distinct(), ["role", "e"], "left_semi")
    d = d.withColumn("g", F.coalesce("g", F.lit(0))).drop("any").dropna()
    return first_by(d, ["role", "e", "t"], ["g", "y", *(f"x{i}" for i in range(len(x)))])


def identified(counts: list[tuple[str, int, int, int]], sizes: dict[tuple[str, int], int], min_cohort: int, before: int, after: int, min_treated: int = 1) -> list[tuple[str, int, int]]:
    """(role, g, t) whose rows stay, from the numbers of rows by (role, g, t) and of units by (role, g).

    Cohorts of under min_cohort units go. Of the rest, periods from `before` ahead of the first cohort to `after` past
    the last stay, for a treated unit only those within its own window; then only periods that have a control (never
    treated or not yet), and of periods since treatment only cells with min_treated rows.
    """
    out = []
    for role in sorted({r for r, *_ in counts}):
        big = {g for (r, g), n in sizes.items() if r == role and g and n >= min_cohort}
        if not big:
            continue
        first, last = min(big) - before, max(big) + after
        here = [(g, t, n) for r, g, t, n in counts if r == role and first <= t <= last and (g == 0 or g in big and -before <= t - g <= after)]
        free = {t for g, t, _ in here if g == 0 or g > t}
        out += [(role, g, t) for g, t, n in here if t in free and (g == 0 or t < g or n >= min_treated)]
    return sorted(out)


def role_sample(df: DataFrame, y: str, entity: str, time: str, roles: dict[str, str], overall: str | None = None, x: list[str] | None = None, strict: bool = True, min_cohort: int = 200, before: int = 2, after: int = 3, min_treated: int = 1, parameters: Parameters | None = None) -> DataFrame:
    """role_rows, written once, without the rows of cells that identify nothing (see identified). Parameters stand for min_cohort, before and after."""
    if parameters:
        min_cohort, before, after = parameters.min_cohort, parameters.before, parameters.after
    d = stage(role_rows(df, y, entity, time, roles, overall, x or [], strict), "role-rows")
    counts = [(r["role"], r["g"], r["t"], r["n"]) for r in d.groupBy("role", "g", "t").agg(F.count("*").alias("n")).collect()]  # one row a cell
    sizes = {(r["role"], r["g"]): r["n"] for r in d.where("g > 0").groupBy("role", "g").agg(F.countDistinct("e").alias("n")).collect()}
    keep = identified(counts, sizes, min_cohort, before, after, min_treated)
    cells = d.sparkSession.createDataFrame(keep, "role string, g long, t long")
    return d.join(F.broadcast(cells), ["role", "g", "t"])


def changes(d: DataFrame, x: list[str]) -> tuple[DataFrame, dict[str, tuple]]:
    """Rows (cell, w, x0.., n, dy) of all comparisons, and the cells by name: (role, g, t).

    A cell compares its cohort (w = 1) with units not yet or never treated by the change from the base period: g - 1
    from g on, the period before t earlier. Units without one of both periods are not in it; x is that of the base.
    Units that agree in cell, w and x are one row with their number n and the sum dy of their changes: effects are sums
    that need no more. A unit's periods meet in its own row, so that no row of a cell is shuffled.
    """
    names = [f"x{i}" for i in range(len(x))]
    seen = sorted((r["role"], r["g"], r["t"]) for r in d.where("g > 0").select("role", "g", "t").distinct().collect())
    cells = {f"{r}|{g}|{t}": (r, g, t) for r, g, t in seen}
    table = d.sparkSession.createDataFrame([(n, r, g, t, g - 1 if t >= g else t - 1) for n, (r, g, t) in cells.items()], "cell string, role string, cg long, ct long, cb long")
    # a unit has one row a period in a role
    of = table.groupBy("role").agg(F.collect_list(F.struct("cell", "cg", "ct", "cb")).alias("cells"))
    units = dealt(d, "role", "e").groupBy("role", "e").agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("g", "y", *names)))).alias("at"))
    z = units.join(F.broadcast(of), "role").select("at", F.explode("cells").alias("c"))  # one row a role
    z = z.select("c.*", F.col("at")[F.col("c.ct")].alias("now"), F.col("at")[F.col("c.cb")].alias("base")).where("now IS NOT NULL AND base IS NOT NULL")
    z = z.where((F.col("now.g") == F.col("cg")) | (F.col("now.g") == 0) | (F.col("now.g") > F.greatest("ct", "cb")))
    z = z.select("cell", (F.col("now.g") == F.col("cg")).cast("double").alias("w"), (F.col("now.y") - F.col("base.y")).alias("dy"), *[F.col(f"base.{n}").alias(n) for n in names])
    return z.groupBy("cell", "w", *names).agg(F.count("*").cast("double").alias("n"), F.sum("dy").alias("dy")), cells


def _sums(z: DataFrame, columns: list[str], work: Callable, shared: dict, width: int) -> dict[str, np.ndarray]:
    """Per cell the sum of work(rows, the cell's shared value) over all tasks: a few numbers a cell."""
    given = z.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}
        for b in batches:
            cell = np.array(b.column(0).to_pylist())
            m = np.column_stack([b.column(i + 1).to_numpy() for i in range(len(columns))]) if b.num_rows else np.zeros((0, len(columns)))
            for c in np.unique(cell):
                held[c] = held.get(c, np.zeros(width)) + work(m[cell == c], given.value.get(c))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["cell", "v"])

    each = z.select("cell", *columns).mapInArrow(run, "cell string, v array<double>").select("cell", F.posexplode("v").alias("i", "v")).groupBy("cell", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in each.collect():
        out.setdefault(r["cell"], np.zeros(width))[r["i"]] = r["v"]
    return out


def fit_cells(z: DataFrame, k: int, rounds: int = 25, trim: float = 0.995) -> dict[str, tuple[float, int, int, str]]:
    """Effect, treated, controls and method of each cell of changes with k covariates; cells without both groups are left out. Rows without n are one unit each.

    All cells are fitted together by sums grouped by cell: the outcome regression of controls' changes on x from one
    pass of cross products, the logistic propensity by Newton steps of one pass each. The methods, the first that can be
    had: doubly robust (the cohort's mean residual less that of controls weighted by p / (1 - p), weights normalised, p
    at most trim); inverse probability (the same weights on the changes themselves, where the regression is singular);
    difference of means (weights of a propensity without covariates, where the propensity does not settle).
    """
    p = k + 1
    if "n" not in z.columns:
        z = z.withColumn("n", F.lit(1.0))
    columns = ["w", "n", "dy", *(f"x{i}" for i in range(k))]
    ones = lambda m: np.column_stack([np.ones(len(m)), m[:, 3:]])

    def moments(m, _):
        q, c, n = ones(m), m[:, 0] == 0, m[:, 1]
        return np.r_[m[:, 0] @ n, (1 - m[:, 0]) @ n, ((q[c].T * n[c]) @ q[c]).ravel(), q[c].T @ m[c, 2], n @ q, n @ (q * q)]

    got = {c: v for c, v in _sums(z, columns, moments, {}, 2 + p * p + 3 * p).items() if v[0] and v[1]}
    beta, centre = {}, {}
    for c, v in got.items():
        cross = v[2 : 2 + p * p].reshape(p, p)
        if np.linalg.matrix_rank(cross) == p:
            beta[c] = np.linalg.solve(cross, v[2 + p * p : 2 + p * p + p])
        mean = v[-2 * p : -p] / (v[0] + v[1])
        centre[c] = (mean, np.sqrt(np.maximum(v[-p:] / (v[0] + v[1]) - mean**2, 1e-12)))

    def standard(m, mean, sd):
        q = ones(m)
        q[:, 1:] = (q[:, 1:] - mean[1:]) / sd[1:]
        return q

    def step(m, given):
        if given is None:
            return np.zeros(p + p * p)
        q = standard(m, *given[1:])
        ps = 1 / (1 + np.exp(-np.clip(q @ given[0], -35, 35)))
        return np.r_[q.T @ (m[:, 1] * (m[:, 0] - ps)), ((q * (m[:, 1] * ps * (1 - ps))[:, None]).T @ q).ravel()]

    theta = {c: np.r_[np.log(v[0] / v[1]), np.zeros(p - 1)] for c, v in got.items()}
    walking, settled = set(theta) if k else set(), {}
    for _ in range(rounds):
        if not walking:
            break
        for c, v in _sums(z, columns, step, {c: (theta[c], *centre[c]) for c in walking}, p + p * p).items():
            if c not in walking:
                continue
            h = v[p:].reshape(p, p)
            if np.linalg.matrix_rank(h) < p or not np.isfinite(theta[c]).all() or np.abs(theta[c]).max() > 30:
                walking.discard(c)
                continue
            move = np.linalg.solve(h, v[:p])
            theta[c] = theta[c] + np.clip(move, -4, 4)
            if np.abs(move).max() < 1e-9:
                settled[c] = theta[c]
                walking.discard(c)

    def effect(m, given):
        if given is None:
            return np.zeros(4)
        b, th, mean, sd = given
        w, n = m[:, 0], m[:, 1]
        res = m[:, 2] - (0 if b is None else n * (ones(m) @ b))  # summed over the n units of a row
        odds = (1 - w) if th is None else (1 - w) * (lambda ps: ps / (1 - ps))(np.minimum(1 / (1 + np.exp(-np.clip(standard(m, mean, sd) @ th, -35, 35))), trim))
        return np.array([w @ res, w @ n, odds @ res, odds @ n])

    last = _sums(z, columns, effect, {c: (beta.get(c) if c in settled else None, settled.get(c), *centre[c]) for c in got}, 4)
    method = {c: "difference of means" if c not in settled else "doubly robust" if c in beta else "inverse probability" for c in got}
    return {c: (float(v[0] / v[1] - v[2] / v[3]), int(got[c][0]), int(got[c][1]), method[c]) for c, v in last.items() if c in got}


def att_gt_by_role(sample: DataFrame, x: list[str] | None = None, rounds: int = 25, trim: float = 0.995) -> DataFrame:
    """role, g, t, k, att, n_treated, n_control, method of each cell of a role_sample, made with the same x."""
    schema = "role string, g long, t long, k long, att double, n_treated long, n_control long, method string"
    z, cells = changes(stage(sample, "role-sample"), x or [])
    if not cells:
        return sample.sparkSession.createDataFrame([], schema)
    fits = fit_cells(stage(z, "changes"), len(x or []), rounds, trim)
    return sample.sparkSession.createDataFrame([(r, g, t, t - g, *fits[n]) for n, (r, g, t) in cells.items() if n in fits], schema)


def att_overall(cells: DataFrame) -> DataFrame:
    """role, att, n_cells: the plain mean of the cells from treatment on, of all cells where there are none."""
    post = F.avg(F.when(F.col("t") >= F.col("g"), F.col("att")))
    return cells.groupBy("role").agg(F.coalesce(post, F.avg("att")).alias("att"), F.count("att").alias("n_cells"))


def att_dynamic_by_role(cells: DataFrame, sample: DataFrame, lo: int, hi: int) -> DataFrame:
    """role, k, att, n_cohorts: cohort effects weighted by the numbers of the sample's units in each cohort."""
    sizes = sample.where("g > 0").groupBy("role", "g").agg(F.countDistinct("e").alias("u"))
    x = cells.join(sizes, ["role", "g"]).where(F.col("k").between(lo, hi))
    return x.groupBy("role", "k").agg(ratio(F.sum(F.col("u") * F.col("att")), F.sum("u")).alias("att"), F.count("*").alias("n_cohorts"))
