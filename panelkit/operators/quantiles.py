"""Exact quantiles of whole columns, and of columns by group, by narrowing brackets; no task and no driver ever holds all values of a column or group."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import stage

#: Values inside a bracket that are looked at one by one, and accuracy of the sketches that narrow it.
INSIDE, ACCURACY = 2_000, 10_000
#: Steps of the sketch that narrows the brackets of a group (its accuracy is 10 times as fine).
STEPS = 256


def exact_quantiles(df: DataFrame, wanted: list[tuple[str, str, list[float]]]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each (name, SQL condition or column, probabilities): the expression's values that are not NULL. Without values: None."""
    return counted_quantiles(df, wanted)[0]


def counted_quantiles(df: DataFrame, wanted: list[tuple[str, str, list[float]]], written: bool = False) -> tuple[dict[str, list[float | None]], dict[str, int]]:
    """Quantiles as exact_quantiles gives them, and the number of values of each name.

    One pass counts and sketches all columns, one sketch each; it brackets each probability's two neighbouring ranks by
    two values. A last pass counts the values inside the brackets by value, and those on the shorter side outside.
    Columns whose first brackets may hold more than INSIDE values have passes between: one sketches the inside of their brackets, another counts
    the values below and inside the narrower ones, until at most INSIDE values, or a single one, are left in each.
    written: df is a stage, so its columns need not be written again.
    """
    prob = {(n, i): p for n, _, ps in wanted for i, p in enumerate(ps)}
    if not prob:
        return {n: [] for n, _, _ in wanted}, {}
    # equal expressions are one column, written once: no pass runs (or broadcasts for) the joins behind df again
    place = {e: f"v{i}" for i, e in enumerate(dict.fromkeys(e for _, e, _ in wanted))}
    df = df.select(*[F.expr(e).cast("double").alias(v) for e, v in place.items()])
    df = df if written else stage(df, "columns")
    cols = {name: F.when(~F.isnan(v), F.col(v)) for name, e, _ in wanted for v in [place[e]]}
    slack = 3 / ACCURACY + 1 / INSIDE  # the sketch's error, and a rank where there are more than INSIDE values
    ends = lambda p: [max(0.0, p - slack), min(1.0, p + slack)]
    each = [(F.count(cols[n]).alias(f"n{j}"), F.percentile_approx(cols[n], [x for p in ps for x in ends(p)] or [0.5], ACCURACY).alias(f"q{j}")) for j, (n, _, ps) in enumerate(wanted)]
    r = df.agg(*[c for pair in each for c in pair]).first()
    total = {n: r[f"n{j}"] for j, (n, _, _) in enumerate(wanted)}
    bracket = {}
    for j, (n, _, ps) in enumerate(wanted):
        for i, p in enumerate(ps):
            few = total[n] <= INSIDE
            bracket[n, i] = (-math.inf if few or p <= slack else r[f"q{j}"][2 * i], math.inf if few or p >= 1 - slack else r[f"q{j}"][2 * i + 1])
    bracket |= _narrowed(df, cols, prob, total, {k: v for k, v in bracket.items() if 2 * slack * total[k[0]] > INSIDE})
    some = [k for k in bracket if total[k[0]]]
    out: dict[str, list[float | None]] = {n: [None] * len(ps) for n, _, ps in wanted}
    if not some:
        return out, total

    def entry(j: int, k: tuple):
        v, (lo, hi) = cols[k[0]], bracket[k]
        outside = v < lo if prob[k] < 0.5 else v > hi
        return F.when(outside, F.struct(F.lit(j).alias("j"), F.lit(None).cast("double").alias("v"))).when((v >= lo) & (v <= hi), F.struct(F.lit(j).alias("j"), v.alias("v")))

    rows = df.select(F.explode(F.array_compact(F.array(*[entry(j, k) for j, k in enumerate(some)]))).alias("e")).groupBy("e.j", "e.v").agg(F.count("*").alias("n")).collect()
    values: list[list[tuple[float, int]]] = [[] for _ in some]
    beyond = [0] * len(some)
    for r in rows:
        if r["v"] is None:
            beyond[r["j"]] = r["n"]
        else:
            values[r["j"]].append((r["v"], r["n"]))
    for j, k in enumerate(some):
        held = sorted(values[j])
        below = beyond[j] if prob[k] < 0.5 else total[k[0]] - beyond[j] - sum(n for _, n in held)
        h = prob[k] * (total[k[0]] - 1)
        at = [_ranked(held, math.floor(h) - below), _ranked(held, math.ceil(h) - below)]
        out[k[0]][k[1]] = at[0] + (at[1] - at[0]) * (h - math.floor(h))
    return out, total


def _narrowed(df: DataFrame, cols: dict, prob: dict, total: dict, open_: dict) -> dict:
    """Brackets narrowed until at most INSIDE values, or a single one, are in each."""
    inside = lambda k, lo, hi: F.when((cols[k[0]] >= lo) & (cols[k[0]] <= hi), cols[k[0]])

    def tallied(brackets: dict) -> dict:
        """Values below and inside each bracket."""
        r = df.agg(*[c for j, (k, b) in enumerate(brackets.items()) for c in (F.count_if(cols[k[0]] < b[0]).alias(f"b{j}"), F.count(inside(k, *b)).alias(f"n{j}"))]).first()
        return {k: (r[f"b{j}"], r[f"n{j}"]) for j, k in enumerate(brackets)}

    open_, done = dict(open_), {}
    seen = tallied(open_) if open_ else {}
    while True:
        for k in [k for k, (lo, hi) in open_.items() if seen[k][1] <= INSIDE or lo == hi]:
            done[k] = open_.pop(k)
        if not open_:
            return done
        r = df.agg(*[F.percentile_approx(inside(k, *b), _around(prob[k], total[k[0]], *seen[k]), ACCURACY).alias(f"q{j}") for j, (k, b) in enumerate(open_.items())]).first()
        narrow = {k: tuple(r[f"q{j}"]) for j, k in enumerate(open_)}
        for k in [k for k in open_ if narrow[k] == open_[k]]:  # nothing left to narrow: few values, each very often
            done[k] = open_.pop(k)
            del narrow[k]
        if narrow:
            seen |= tallied(narrow)
            open_ |= narrow


def _around(p: float, total: int, below: int, n: int) -> list[float]:
    """Probabilities inside a bracket that enclose both ranks of p, with room for the sketch's error."""
    lo, hi = (math.floor(p * (total - 1)) - below) / n, (math.ceil(p * (total - 1)) - below + 1) / n
    slack = 3 / ACCURACY
    return [min(1.0, max(0.0, lo - slack)), max(0.0, min(1.0, hi + slack))]


def _ranked(values: list[tuple[float, int]], rank: int) -> float:
    for v, n in values:
        rank -= n
        if rank < 0:
            return v
    return values[-1][0]


def quantiles_by(df: DataFrame, by: list[str], value: str, wanted: list[float]) -> DataFrame:
    """by and q, an array: linearly interpolated quantiles of value in each group that has any; missing group keys are a group.

    The same narrowing as exact_quantiles, with one bracket for each (group, probability) in a table, as there may be
    any number of groups. Groups of at most INSIDE values are counted by value at once. In larger ones a mergeable
    sketch of STEPS steps inside each bracket leaves about 3 / STEPS of it a round, and a pass counts what lies below.
    """
    keys = [f"__b{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    x = stage(df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], v.alias("__v")).where(v.isNotNull() & ~F.isnan(v)), "values")
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(float(p)).alias("__p")) for i, p in enumerate(wanted)]))
    state = x.groupBy(*keys).agg(F.count("*").alias("__total")).select(*keys, "__total", each)
    state = state.withColumns({"__lo": F.lit(-math.inf), "__hi": F.lit(math.inf), "__below": F.lit(0).cast("long"), "__n": F.col("__total"), "__open": F.col("__total") > INSIDE})
    own, columns = [*keys, "__i"], [*keys, "__i", "__p", "__total", "__lo", "__hi", "__below", "__n", "__open"]

    def within(brackets: DataFrame) -> DataFrame:
        """Values with each bracket of their group."""
        b = brackets.select(*[F.col(k).alias(f"{k}r") for k in keys], *columns[len(keys) :])
        return x.join(b, reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys])).drop(*(f"{k}r" for k in keys))

    inside = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
    state = stage(state.select(columns), "brackets")
    while not state.where("__open").isEmpty():
        held = [*own, "__p", "__total", "__lo", "__hi", "__below", "__n"]
        cuts = within(state.where("__open")).where(inside).groupBy(*held).agg(F.percentile_approx("__v", [i / STEPS for i in range(STEPS + 1)], 10 * STEPS).alias("__g"))
        h = F.col("__p") * (F.col("__total") - 1)
        share = lambda rank: (rank - F.col("__below")) / F.col("__n") * STEPS
        low = F.greatest(F.lit(0), F.floor(share(F.floor(h))) - 1).cast("int")
        high = F.least(F.lit(STEPS), F.ceil(share(F.ceil(h) + 1)) + 1).cast("int")
        narrow = cuts.withColumns({"__l": F.col("__g")[low], "__h": F.col("__g")[high]})
        narrow = stage(narrow.select(*own, "__p", "__total", F.col("__l").alias("__lo"), F.col("__h").alias("__hi"), F.lit(0).cast("long").alias("__below"), F.col("__n"), ((F.col("__l") > F.col("__lo")) | (F.col("__h") < F.col("__hi"))).alias("__open")), "narrow")
        moved = within(narrow).groupBy(*own, "__p", "__total", "__lo", "__hi", "__open").agg(F.count_if(F.col("__v") < F.col("__lo")).alias("__below"), F.count_if(inside).alias("__n"))
        moved = moved.withColumn("__open", F.col("__open") & (F.col("__n") > INSIDE) & (F.col("__lo") < F.col("__hi")))
        state = stage(state.where("not __open").unionByName(moved.select(columns)), "brackets")
    counts = within(state).where(inside).groupBy(*own, "__p", "__total", "__below", "__v").agg(F.count("*").alias("__m"))
    upto = F.col("__below") + F.sum("__m").over(Window.partitionBy(*own).orderBy("__v"))  # few values a bracket
    h = F.col("__p") * (F.col("__total") - 1)
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))
    ends = counts.withColumn("__upto", upto).groupBy(*own, "__p", "__total").agg(at(F.floor(h)).alias("__a"), at(F.ceil(h)).alias("__z"))
    q = F.struct("__i", (F.col("__a") + (F.col("__z") - F.col("__a")) * (h - F.floor(h))).alias("q"))
    return ends.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(q)), lambda s: s["q"]).alias("q")).select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "q")
