"""Stable moves of units between states, performance around them, and comparison with peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import sum0
from ..functions.scalars import ratio
from .stages import dealt, stage
from .windows import first_by


def stable_moves(rows: DataFrame, unit: str, state: str, order: list[str], min_rows: int = 5) -> DataFrame:
    """rows at which a unit changes state for good, as (unit, move order columns, from_state, to_state).

    Two rows before have one state, this and the two after another; all of them have a state. Units with fewer than
    min_rows rows are left out; the first move per (unit, to, from) stays.
    """
    rows = dealt(rows.select(unit, state, *order).where(F.col(unit).isNotNull()), unit)
    if min_rows > 5:  # a move itself takes five rows
        rows = rows.join(rows.groupBy(unit).agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).select(unit), unit, "left_semi")
    w = Window.partitionBy(unit).orderBy(*order)
    x = rows.withColumns({"__p1": F.lag(state, 1).over(w), "__p2": F.lag(state, 2).over(w), "__n1": F.lead(state, 1).over(w), "__n2": F.lead(state, 2).over(w)})
    hit = x.where((F.col(state) != F.col("__p1")) & (F.col("__p2") == F.col("__p1")) & (F.col("__n1") == F.col(state)) & (F.col("__n2") == F.col("__n1")))
    out = hit.select(unit, *order, F.col("__p1").alias("from_state"), F.col(state).alias("to_state"))
    return first_by(out, [unit, "to_state", "from_state"], order)


def performance_around(moves: DataFrame, rows: DataFrame, unit: str, move_year: str, year: str, distinct: dict[str, str], sums: list[str], means: list[str], window: int = 5) -> dict[str, DataFrame]:
    """Metrics of the movers' rows around each move.

    pre: years -window to -1, post: 0 to window-1. Tables: long by period, wide with changes, long by year, wide by year.
    """
    rel = F.col(year) - F.col("__m")
    m = moves.select(unit, F.col(move_year).alias("__m")).distinct()
    x = m.join(rows, unit).withColumn("rel", rel).where(F.col("rel").between(-window, window - 1))
    x = x.withColumn("period", F.when(F.col("rel") < 0, "pre").otherwise("post")).withColumn(move_year, F.col("__m"))
    agg = [F.countDistinct(c).alias(k) for k, c in distinct.items()] + [sum0(c).alias(f"sum_{c}") for c in sums] + [F.avg(c).alias(f"mean_{c}") for c in means]
    names = [*distinct, *(f"sum_{c}" for c in sums), *(f"mean_{c}" for c in means)]
    keys = [unit, move_year]
    long = x.groupBy(*keys, "period").agg(*agg)
    wide = long.groupBy(*keys).pivot("period", ["pre", "post"]).agg(*[F.first(n).alias(n) for n in names])
    if len(names) == 1:
        wide = wide.withColumnsRenamed({p: f"{p}_{names[0]}" for p in ("pre", "post")})
    wide = wide.withColumns({f"change_{n}": F.col(f"post_{n}") - F.col(f"pre_{n}") for n in names})
    annual = x.groupBy(*keys, "rel").agg(*agg)
    sign = F.when(F.col("rel") < 0, F.concat(F.lit("m"), (-F.col("rel")).cast("string"))).otherwise(F.concat(F.lit("p"), F.col("rel").cast("string")))
    levels = [f"m{k}" for k in range(window, 0, -1)] + [f"p{k}" for k in range(window)]
    by_year = annual.withColumn("at", sign).groupBy(*keys).pivot("at", levels).agg(*[F.first(n).alias(n) for n in names])
    return {"long": long, "wide": wide, "annual": annual, "annual_wide": by_year}


def peer_benchmark(moves: DataFrame, rows: DataFrame, unit: str, firm: str, year: str, doc: str, metric: str, window: int = 5, epsilon: float = 1e-9, zero_peer: str = "epsilon") -> DataFrame:
    """Per move the mean metric and distinct documents of the mover and of the firm's other units, before and after.

    moves: unit, move_year, from_state, to_state. pre: [m-window, m-1], post: [m, m+window-1]. Cells of (firm, year,
    unit) are summed first, peers are the firm's total less the mover. Distinct documents of peers are those with a row
    of another unit. Ratios are m / (p + epsilon); zero_peer='null' gives NULL where peers have nothing.
    """
    cells = stage(rows.groupBy(firm, year, unit).agg(sum0(metric).alias("s"), F.count(metric).alias("n")), "cells")
    firm_years = cells.groupBy(firm, year).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    # dealt by document, so that no count of a document's rows shuffles them again
    docs = stage(dealt(rows.select(firm, year, doc, unit), doc).distinct(), "docs")
    teams = stage(dealt(docs, doc).groupBy(firm, year, doc).agg(F.count("*").alias("k")), "teams")
    m = moves.select(F.col(unit).alias("__u"), F.col("move_year").alias("__m"), "from_state", "to_state").distinct()
    # each move twice, at its origin and at its destination; both windows are summed in one join
    place = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("at"))
    m = stage(m.withColumn("p", F.explode(F.array(place("origin", "from_state"), place("dest", "to_state")))).select("__u", "__m", "from_state", "to_state", "p.*"), "moves")
    keys = ["__u", "__m", "from_state", "to_state"]
    sides = {"pre": F.col("rel") < 0, "post": F.col("rel") >= 0}

    def near(left: DataFrame, t: DataFrame, *on) -> DataFrame:
        rel = t[year] - left["__m"]
        cond = (t[firm] == left["at"]) & rel.between(-window, window - 1)
        for c in on:
            cond = cond & c
        return left.join(t, cond).withColumn("rel", rel)

    by_side = lambda f, **cs: [f(F.when(w, F.col(c))).alias(f"{k}_{n}") for n, w in sides.items() for k, c in cs.items()]
    # totals depend on the firm and the year of the move only, so they are made once for all its moves
    pairs = m.select("at", "__m").distinct()
    total = near(pairs, firm_years).groupBy("at", "__m").agg(*by_side(F.sum, ts="s", tn="n"))
    seen = near(pairs, dealt(teams, doc)).groupBy("at", "__m", doc).agg(*by_side(F.count, c="k"))
    all_docs = seen.groupBy("at", "__m").agg(*[F.count_if(F.col(f"c_{n}") > 0).alias(f"all_{n}") for n in sides])
    # the mover's depend on unit, year and firm only
    units = stage(m.select("__u", "__m", "at").distinct(), "units")
    own = near(units, cells, cells[unit] == units["__u"]).groupBy("__u", "__m", "at").agg(*by_side(F.sum, ms="s", mn="n"))
    # dealt by document, as the teams that they meet are
    held = dealt(near(units, docs, docs[unit] == units["__u"]).select("__u", "__m", "at", docs[doc].alias("__d"), "rel"), "__d")
    mine = held.groupBy("__u", "__m", "at", "__d").agg(*by_side(F.count, years="at"))
    # alone: in no year of the window does another unit have the document at the firm
    dealt_teams = dealt(teams, doc)
    mine = near(mine, dealt_teams, dealt_teams[doc] == mine["__d"]).groupBy("__u", "__m", "at", "__d", *[f"years_{n}" for n in sides]).agg(*by_side(F.sum, k="k"))
    has = lambda n: F.col(f"years_{n}") > 0
    mine = mine.groupBy("__u", "__m", "at").agg(*[F.count_if(has(n)).alias(f"md_{n}") for n in sides], *[F.count_if(has(n) & (F.col(f"k_{n}") == F.col(f"years_{n}"))).alias(f"alone_{n}") for n in sides])
    x = m.join(total, ["at", "__m"], "left").join(all_docs, ["at", "__m"], "left").join(own, ["__u", "__m", "at"], "left").join(mine, ["__u", "__m", "at"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = []
    for role, side in (("origin", "pre"), ("dest", "pre"), ("dest", "post")):
        values = {
            "mover": ratio(F.col(f"ms_{side}"), F.col(f"mn_{side}")), "peers": ratio(F.col(f"ts_{side}") - zero(f"ms_{side}"), F.col(f"tn_{side}") - zero(f"mn_{side}")),
            "mover_docs": zero(f"md_{side}"), "peers_docs": zero(f"all_{side}") - zero(f"alone_{side}"),
        }
        parts += [F.max(F.when(F.col("role") == role, v)).alias(f"{k}_{role}_{side}") for k, v in values.items()]
    out = x.groupBy(*keys).agg(*parts)

    def against(a: str, b: str):
        den = F.col(b) if zero_peer == "null" else F.col(b) + epsilon
        return ratio(F.col(a), den)

    for name, a, b in (("origin", "origin_pre", "origin_pre"), ("mover_pre_dest", "origin_pre", "dest_pre"), ("dest", "dest_post", "dest_post")):
        out = out.withColumn(f"ratio_{name}", against(f"mover_{a}", f"peers_{b}")).withColumn(f"docs_ratio_{name}", against(f"mover_docs_{a}", f"peers_docs_{b}"))
    return out.withColumnsRenamed({"__u": unit, "__m": "move_year"})
