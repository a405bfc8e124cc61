"""The placebo suite: each role's false treatments under four estimators, for the outcomes on which the real one shows.

Both kinds of false treatment of all roles are columns of one wide table, which is written once. The gate and the suite
are one call of many fits each, so an entity's rows are shuffled once for all roles, kinds, outcomes and estimators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import Parameters
from .estimators import cohort_average
from .gram import Fit, fe_many
from .resample import placebo_columns
from .stages import stage

KINDS = ("lead", "permute")
METHODS = ("did", "event_study", "sun_abraham", "imputation")


def wide_placebos(df: DataFrame, outcomes: list[str], entity: str, time: str, roles: dict[str, str], overall: str, lead: int, lo: int, hi: int, ref: int, seed: int) -> DataFrame:
    """df's entity, period and outcomes with, for each role: in_, d_<role>; for each role and kind: use_ and g_, k_, d_, within_, pair_, es_<tag>.

    A role's rows are those of units exposed in it and of units never exposed at all. within: before the real treatment
    and in the window of event time (lo to lead - 1 for lead, lo to hi for permute) or never treated. pair: within,
    where the entity has two such rows or more. es: the number of the event time among lo to hi without ref.
    """
    d = stage(df.select(entity, time, *dict.fromkeys([*outcomes, *roles.values(), overall])), "panel")
    numbers = [k for k in range(lo, hi + 1) if k != ref]
    for role, g in roles.items():
        cohort, every = F.coalesce(F.col(g), F.lit(0)), F.coalesce(F.col(overall), F.lit(0))
        d = d.withColumns({f"in_{role}": (cohort > 0) | (every == 0), f"d_{role}": ((cohort > 0) & (F.col(time) >= cohort)).cast("int")})
        for kind in KINDS:
            tag = f"{role}_{kind}"
            d = placebo_columns(d, entity, time, g, kind, lead, seed, tag)
            k = F.col(f"k_{tag}")
            inside = k.isNull() | k.between(lo, lead - 1 if kind == "lead" else hi)
            place = F.array_position(F.array(*map(F.lit, numbers)), k.cast("int")) - 1
            d = d.withColumn(f"use_{tag}", F.col(f"use_{tag}") & F.col(f"in_{role}"))
            d = d.withColumns({f"within_{tag}": F.col(f"use_{tag}") & inside, f"es_{tag}": F.when(place >= 0, place)})
    tags = [f"{r}_{k}" for r in roles for k in KINDS]
    own = Window.partitionBy(entity)
    return d.withColumns({f"pair_{t}": F.col(f"within_{t}") & (F.sum(F.col(f"within_{t}").cast("int")).over(own) >= 2) for t in tags})


def cohort_cells(d: DataFrame, entity: str, time: str, tags: list[str], lo: int, hi: int, ref: int) -> dict[str, tuple[dict[str, tuple[int, int]], dict[int, int], int, int]]:
    """For each tag: its (cohort, k) cells by name, units by cohort, first and last period; from one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(f"g_{t}").cast("long").alias("g"), F.col(f"pair_{t}").alias("on")) for t in tags]))
    rows = d.select(F.col(entity).alias("e"), F.col(time).cast("long").alias("t"), each.alias("s")).where("s.on").select("e", "t", "s.tag", "s.g")
    spans = {(r["tag"], r["g"]): r for r in rows.groupBy("tag", "g").agg(F.collect_set("t").alias("ts"), F.countDistinct("e").alias("n")).collect()}  # one row a cohort
    out = {}
    for tag in tags:
        mine = {g: r for (x, g), r in spans.items() if x == tag}
        every = [t for r in mine.values() for t in r["ts"]]
        cells = sorted((g, t - g) for g, r in mine.items() if g > 0 for t in r["ts"] if lo <= t - g <= hi and t - g != ref)
        out[tag] = ({f"g{g}_k{k}": (g, k) for g, k in cells}, {g: r["n"] for g, r in sorted(mine.items()) if g > 0}, min(every, default=0), max(every, default=0))
    return out


def placebo_studies(df: DataFrame, outcomes: list[str], entity: str, time: str, roles: dict[str, str], overall: str, lead: int = 3, lo: int = -5, hi: int = 5, ref: int = -1, alpha: float | None = 0.05, seed: int = 42, parameters: Parameters | None = None) -> DataFrame:
    """role, kind, outcome, method, k, coef, se, n: false treatments of each role on the outcomes that pass its gate.

    The gate takes outcomes on which the role's real two-way effect has p below alpha (None: all). did: the two-way
    effect over all rows before the real treatment, k NULL; the others take the rows within the window. event_study and
    sun_abraham: coefficients by event time, ref left out; imputation: mean effects of rows from the false treatment
    on, no se. n: rows of the fit, cohorts, or rows that are averaged. A fit that has nothing to tell gives no row.
    Parameters stand for lead, window, reference, alpha and seed.
    """
    if parameters:
        lead, (lo, hi), ref, alpha, seed = parameters.lead, parameters.window, parameters.reference, parameters.alpha, parameters.seed
    schema = "role string, kind string, outcome string, method string, k int, coef double, se double, n long"
    d = stage(wide_placebos(df, outcomes, entity, time, roles, overall, lead, lo, hi, ref, seed), "placebos")
    real = fe_many(d, [Fit(f"{r}|{y}", y, [f"d_{r}"], f"in_{r}") for r in roles for y in outcomes], entity, time) if alpha is not None else {}
    passed = lambda r, y: alpha is None or any(x["p"] is not None and x["p"] < alpha for x in real[f"{r}|{y}"].rows())
    studied = [(r, k, y, f"{r}_{k}") for r in roles for k in KINDS for y in outcomes if passed(r, y)]
    if not studied:
        return df.sparkSession.createDataFrame([], schema)
    tags = list(dict.fromkeys(t for *_, t in studied))
    cohorts = cohort_cells(d, entity, time, tags, lo, hi, ref)
    own = {t: F.concat_ws("|", F.col(f"g_{t}").cast("string"), (F.col(time).cast("long") - F.col(f"g_{t}")).cast("string")) for t in tags}
    number = lambda t: F.element_at(F.create_map(*[v for i, (g, k) in enumerate(cohorts[t][0].values()) for v in (F.lit(f"{g}|{k}"), F.lit(i))]), own[t]) if cohorts[t][0] else F.lit(None).cast("int")
    d = d.withColumns({f"sa_{t}": number(t) for t in tags})
    names = {f"k{k}": k for k in range(lo, hi + 1) if k != ref}
    fits = []
    for *_, y, t in studied:
        fits += [
            Fit(f"did|{t}|{y}", y, [f"d_{t}"], f"use_{t}"),
            Fit(f"event_study|{t}|{y}", y, [], f"within_{t}", f"es_{t}", list(names)),
            Fit(f"sun_abraham|{t}|{y}", y, [], f"pair_{t}", f"sa_{t}", list(cohorts[t][0]), "twoway"),
            Fit(f"imputation|{t}|{y}", y, [], f"within_{t}", impute=(f"d_{t}", f"k_{t}", lo, hi)),
        ]
    got = fe_many(d, fits, entity, time)
    rows = []
    for r, kind, y, t in studied:
        fit = {m: got[f"{m}|{t}|{y}"] for m in METHODS}
        rows += [(r, kind, y, "did", None, x["coef"], x["se"], fit["did"].nobs) for x in fit["did"].rows() if x["coef"] is not None]
        rows += [(r, kind, y, "event_study", names[x["term"]], x["coef"], x["se"], fit["event_study"].nobs) for x in fit["event_study"].rows() if x["coef"] is not None]
        rows += [(r, kind, y, "sun_abraham", *x) for x in cohort_average(fit["sun_abraham"], *cohorts[t], lo, hi, ref)]
        rows += [(r, kind, y, "imputation", k, s / n, None, n) for (w, k), (s, n) in sorted(fit["imputation"].effects.items()) if w]
    return df.sparkSession.createDataFrame(rows, schema)
