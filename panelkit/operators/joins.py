"""Interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(facts: DataFrame, links: DataFrame, key: str, date: str, start: str, end: str) -> DataFrame:
    """facts and the links of the same key that are valid at the date (both ends included). Spark broadcasts links where their size allows it."""
    valid = (F.col(f"f.{key}") == F.col(f"l.{key}")) & F.col(f"f.{date}").between(F.col(f"l.{start}"), F.col(f"l.{end}"))
    return facts.alias("f").join(links.alias("l"), valid).select("f.*", *[F.col(f"l.{c}") for c in links.columns if c not in (key, *facts.columns)])


def two_sided_link(deals: DataFrame, links: DataFrame, date: str, left: str, right: str, code: str, target: str, start: str, end: str) -> DataFrame:
    """deals with `<target>_<left>` and `<target>_<right>`: what either party's code is linked to at the date; equal parties go."""
    out = deals
    for side in (left, right):
        link = links.select(F.col(code).alias(side), F.col(target).alias(f"{target}_{side}"), F.col(start).alias("__s"), F.col(end).alias("__e"))
        out = out.alias("d").join(link.alias("k"), (F.col(f"d.{side}") == F.col(f"k.{side}")) & F.col(f"d.{date}").between(F.col("k.__s"), F.col("k.__e"))).select("d.*", f"k.{target}_{side}")
    return out.where(F.col(f"{target}_{left}") != F.col(f"{target}_{right}"))


def nearest_event(panel: DataFrame, events: DataFrame, entity: str, time: str, event_time: str, payload: list[str], window: int | None = 5, order: list[str] | None = None) -> DataFrame:
    """panel with `years_from_event` and the payload of the nearest event of its entity.

    The event before (or in) the period and the event after (or in) it are found by range frames over the union of
    both tables. The nearer one counts; at equal distance the one before. Of events of one period the side before
    takes the last in `order` (default: payload order), the side after the first. Beyond the window all are NULL.
    """
    tie = order or payload
    pack = F.struct(F.col(event_time).cast("long").alias("at"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
    e = events.where(F.col(entity).isNotNull() & F.col(event_time).isNotNull()).select(F.col(entity).alias("__k"), F.col(event_time).cast("long").alias("__t"), pack.alias("__e"))
    p = panel.select(F.struct(*panel.columns).alias("__row"), F.col(entity).alias("__k"), F.col(time).cast("long").alias("__t"))
    both = p.unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy("__k").orderBy("__t")
    prev = F.max("__e").over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min("__e").over(w.rangeBetween(0, Window.unboundedFollowing))
    found = both.select("__row", "__t", prev.alias("a"), after.alias("b")).where("__row is not null")
    use_b = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b.at") - F.col("__t") < F.col("__t") - F.col("a.at")))
    best = F.when(use_b, F.col("b")).otherwise(F.col("a"))
    near = found.select("__row", "__t", best.alias("e"))
    inside = F.col("e").isNotNull() if window is None else F.abs(F.col("__t") - F.col("e.at")) <= window
    return near.select("__row.*", F.when(inside, F.col("__t") - F.col("e.at")).alias("years_from_event"), *[F.when(inside, F.col(f"e.p{i}")).alias(c) for i, c in enumerate(payload)])


def asof_override(panel: DataFrame, moves: DataFrame, entity: str, time: str, move_time: str, value: str, current: str, name: str) -> DataFrame:
    """panel with `name`: the value of the latest move at or before the period, else `current`. Of moves in one period the last by order column `__seq` (or value) wins."""
    seq = F.col("__seq") if "__seq" in moves.columns else F.lit(0)
    e = moves.select(F.col(entity).alias("__k"), F.col(move_time).cast("long").alias("__t"), F.struct(F.col(move_time).cast("long").alias("at"), seq.alias("s"), F.col(value).alias("v")).alias("__e"))
    p = panel.select(F.struct(*panel.columns).alias("__row"), F.col(entity).alias("__k"), F.col(time).cast("long").alias("__t"))
    w = Window.partitionBy("__k").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    found = p.unionByName(e, allowMissingColumns=True).select("__row", F.max("__e").over(w).alias("m")).where("__row is not null")
    return found.select("__row.*", F.coalesce(F.col("m.v"), F.col(f"__row.{current}")).alias(name))
