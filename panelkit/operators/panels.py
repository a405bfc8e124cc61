"""Builders of firm-year, entity-year and event panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import fill_counts, sum0
from ..functions.scalars import composite_key
from .joins import asof_override, nearest_event
from .stages import dealt
from .windows import cumulative, first_by, forward_fill, modal_value, row_lag


def metrics(rows: DataFrame, keys: list[str], distinct: dict[str, str], sums: list[str], means: list[str]) -> DataFrame:
    """Distinct counts, sums (0 where nothing is there) and means by key; rows without a key go."""
    x = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return x.groupBy(*keys).agg(*[F.countDistinct(c).alias(k) for k, c in distinct.items()], *[sum0(c).alias(f"sum_{c}") for c in sums], *[F.avg(c).alias(f"mean_{c}") for c in means])


def departures_arrivals(moves: DataFrame, unit: str, quality: list[str] | None = None) -> DataFrame:
    """firm, data_year, n_departures, n_arrivals and the mean quality of those who left and came."""
    quality = quality or []
    side = lambda at, name: moves.groupBy(F.col(at).alias("firm"), F.col("move_year").alias("data_year")).agg(F.countDistinct(unit).alias(f"n_{name}"), *[F.avg(q).alias(f"{q}_{name}") for q in quality])
    return fill_counts(side("from_state", "departures").join(side("to_state", "arrivals"), ["firm", "data_year"], "full"), ["n_departures", "n_arrivals"])


def relative_talent(benchmark: DataFrame, origin: dict[str, str], dest: dict[str, str]) -> DataFrame:
    """firm, data_year and the mean standing of those who left among the peers they left, and of those who came among the peers they joined.

    benchmark: move_year, from_state, to_state and ratios (see peer_benchmark). origin, dest: ratio to output name.
    """
    side = lambda at, names: benchmark.groupBy(F.col(at).alias("firm"), F.col("move_year").alias("data_year")).agg(*[F.avg(c).alias(n) for c, n in names.items()])
    return side("from_state", origin).join(side("to_state", dest), ["firm", "data_year"], "full")


def left_chain(spine: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The spine with every part, all of them one row per key: one partitioning serves the whole chain."""
    return reduce(lambda a, b: a.join(b, keys, "left"), parts, spine)


def firm_year_panel(spine: DataFrame, parts: list[DataFrame], counts: list[str], keys: list[str] | None = None) -> DataFrame:
    return fill_counts(left_chain(spine, parts, keys or ["firm", "data_year"]), counts)


def event_study_panel(panel: DataFrame, roles: DataFrame, entity: str, time: str, event_time: str, payload: list[str], window: int = 5, label: str = "role", none: str = "no_recent_MandA") -> DataFrame:
    """The panel with its nearest event, and `none` as the label of rows without one in the window."""
    out = nearest_event(panel, roles, entity, time, event_time, payload, window)
    return out.withColumn(label, F.coalesce(F.col(label), F.lit(none)))


def entity_year_panel(rows: DataFrame, unit: str, year: str, firm: str, distinct: dict[str, str], sums: list[str], means: list[str], moves: DataFrame | None = None, exposure: DataFrame | None = None, roles: dict[str, DataFrame] | None = None) -> DataFrame:
    """A gap-free panel of units from their first to their last year.

    Counts and sums are 0 in empty years, means stay NULL; cum_* are running sums. firm_mode is the modal firm of a
    year (least of equals), firm_assigned carries it forward and the latest move (moves: unit, move_year, to_state)
    overrides it; is_move_year marks moves. exposure (firm, first_year): treated from the first year in which the
    assigned firm is exposed: exposed, cohort (NULL: never). roles gives one such table per role of the firm: they add
    exposed_<role> and cohort_<role>.
    """
    rows = dealt(rows.select(*dict.fromkeys([unit, year, firm, *distinct.values(), *sums, *means])).where(F.col(unit).isNotNull() & F.col(year).isNotNull()), unit)
    m = metrics(rows, [unit, year], distinct, sums, means)
    mode = modal_value(rows.where(F.col(year).isNotNull() & F.col(unit).isNotNull()), [unit, year], firm, "firm_mode")
    spans = m.groupBy(unit).agg(F.min(year).alias("__lo"), F.max(year).alias("__hi"))
    full = spans.select(unit, F.explode(F.sequence("__lo", "__hi")).alias(year))
    p = full.join(m, [unit, year], "left").join(mode, [unit, year], "left")
    counts = [*distinct, *(f"sum_{c}" for c in sums)]
    p = fill_counts(p, counts)
    p = cumulative(p, unit, year, {f"cum_{c}": c for c in counts})
    p = forward_fill(p, unit, year, "firm_mode", "firm_ffill")
    if moves is not None:
        p = asof_override(p, moves, unit, year, "move_year", "to_state", "firm_ffill", "firm_assigned")
        at = moves.select(unit, F.col("move_year").alias(year)).distinct().withColumn("is_move_year", F.lit(1))
        p = fill_counts(p.join(at, [unit, year], "left"), ["is_move_year"])
    else:
        p = p.withColumn("firm_assigned", F.col("firm_ffill")).withColumn("is_move_year", F.lit(0))
    tables = ({"": exposure} if exposure is not None else {}) | {f"_{k}": v for k, v in (roles or {}).items()}
    for name, table in tables.items():
        e = table.select(F.col("firm").alias("firm_assigned"), F.col("first_year").alias("__from"))
        p = p.join(e, "firm_assigned", "left").withColumn(f"exposed{name}", F.coalesce(F.col(year) >= F.col("__from"), F.lit(False)).cast("int")).drop("__from")
    first = Window.partitionBy(unit)
    return p.withColumns({f"cohort{n}": F.min(F.when(F.col(f"exposed{n}") == 1, F.col(year))).over(first) for n in tables})


def feasible_events(panel: DataFrame, events: DataFrame, unit: str, year: str, at: str, lo: int, hi: int) -> DataFrame:
    """Events whose whole window lies inside the unit's span of years."""
    span = panel.groupBy(unit).agg(F.min(year).alias("__a"), F.max(year).alias("__b"))
    # by sorting, as both sides are as long as the units
    return events.join(span.hint("merge"), unit).where((F.col("__a") <= F.col(at) + lo) & (F.col("__b") >= F.col(at) + hi)).drop("__a", "__b")


def balanced_event_panel(panel: DataFrame, events: DataFrame, unit: str, year: str, at: str, lo: int, hi: int, outcomes: list[str], zero: list[str], controls: DataFrame | None = None) -> DataFrame:
    """One row per event and k from lo to hi with the unit's outcomes of that year; treated and control events tagged."""
    e = events.distinct().withColumn("is_control_event", F.lit(0))
    if controls is not None:
        e = e.unionByName(controls.withColumn("is_control_event", F.lit(1)), allowMissingColumns=True)
    e = feasible_events(panel, e, unit, year, at, lo, hi)
    grid = e.withColumn("k", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(year, (F.col(at) + F.col("k")).cast("long"))
    rows = dealt(panel.select(unit, year, *outcomes), unit, year)
    return fill_counts(dealt(grid, unit, year).join(rows, [unit, year], "left"), zero)


def lag_controls(panel: DataFrame, entity: str, time: str, columns: list[str]) -> DataFrame:
    """entity, time and the lagged covariates `<c>_lag1`, kept where they are there already."""
    missing = [c for c in columns if f"{c}_lag1" not in panel.columns]
    x = row_lag(panel, entity, time, missing).withColumnsRenamed({f"{c}_lag": f"{c}_lag1" for c in missing})
    return x.select(entity, time, *[f"{c}_lag1" for c in columns])


def attach_controls(panel: DataFrame, controls: DataFrame, entity: str, time: str) -> DataFrame:
    return panel.join(controls, [entity, time], "left")


def did_inputs(panel: DataFrame, entity: str, time: str, k: str, role: str, lo: int, hi: int, log_outcomes: list[str], covariates: list[str], none: str = "no_recent_MandA", lag_before_filter: bool = False) -> DataFrame:
    """Rows inside the window and control rows, with treated, post, post_treated, g, log1p outcomes and lagged covariates."""
    x = row_lag(panel, entity, time, covariates) if lag_before_filter else panel
    x = x.where(F.col(k).between(lo, hi) | (F.col(role) == none))
    treated = (F.col(role) != none).cast("int")
    post = (F.coalesce(F.col(k), F.lit(-1)) >= 0).cast("int")
    x = x.withColumns({"treated": treated, "post": post, "post_treated": treated * post, "g": F.when(F.col(k).isNotNull(), F.col(time) - F.col(k)).otherwise(0)})
    x = x.withColumns({f"log1p_{c}": F.when(F.col(c) > -1, F.log1p(c)) for c in log_outcomes})
    return x if lag_before_filter else row_lag(x, entity, time, covariates)


def role_vs_control(panel: DataFrame, role: str, key: list[str], k: str, lo: int, hi: int, nearest_only: bool = False) -> DataFrame:
    """Rows of one role and all control events, with a composite unit key and treatment flags."""
    x = panel.where(((F.col("role") == role) | (F.col("is_control_event") == 1)) & F.col(k).between(lo, hi))
    if nearest_only and "control_rank" in x.columns:
        x = x.where((F.col("is_control_event") == 0) | (F.col("control_rank") == 1))
    treated, post = (1 - F.col("is_control_event")), (F.col(k) >= 0).cast("int")
    return x.withColumn("inv_event_id", composite_key(*[F.col(c) for c in key])).withColumns({"treated": treated, "post": post, "post_treated": treated * post})


def panel_dedupe(df: DataFrame, entity: str, time: str, order: list) -> DataFrame:
    """One row per (entity, time), the first in the order given."""
    return first_by(df, [entity, time], order)
