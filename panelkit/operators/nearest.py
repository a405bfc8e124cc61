"""Exact nearest neighbours within blocks, by rings of grid cells instead of all pairs of a block.

Coordinates are such that Euclidean distance bounds the distance from below. Points that coincide are searched once, and
of controls that coincide only the first few ids can matter, so a heavy point costs no more than a light one.

Cells start fine, so that none holds many controls, and grow. In a round, a point meets the controls of its own cell
and all cells around it; whatever is as near as a cell is wide is among them, so a point whose last wanted neighbour is
that near is done. The few that are left after the last round (far from all controls) look at the boxes of occupied
cells: only cells that can hold one of the wanted neighbours are opened.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import dealt, stage

#: Controls of a cell that the first width aims at on average, and may have at most; widths tried below it (powers of 2).
AIM, MOST, FINER = 8, 256, (0, 2, 4, 6, 8, 10, 12)
#: Points times controls up to which a block is compared as a whole.
DIRECT = 4_000_000
#: Rounds of growing cells; distances are compared with this much to spare for rounding.
ROUNDS, SPARE = 6, 1e-9


def _cells(u: list[str], width: Column) -> list[Column]:
    return [F.floor(F.col(c) / width).cast("long").alias(f"__i{k}") for k, c in enumerate(u)]


def first_widths(controls: DataFrame, block: list[str], u: list[str]) -> DataFrame:
    """block, __w: the width of each block's first cells: the largest of some by which no cell has over MOST controls."""
    spread = [F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in u]
    sizes = controls.groupBy(*block).agg(F.count("*").alias("__n"), F.greatest(*spread, F.lit(1e-12)).alias("__s"))
    wide = sizes.withColumn("__w", 4 * F.col("__s") * F.pow(F.lit(float(AIM)) / F.col("__n"), F.lit(1 / len(u)))).select(*block, "__w")
    tried = controls.join(wide, block).withColumn("__f", F.explode(F.array(*map(F.lit, FINER))))
    held = tried.groupBy(*block, "__f", "__w", *_cells(u, F.col("__w") / F.pow(F.lit(2.0), F.col("__f")))).agg(F.count("*").alias("__n")).groupBy(*block, "__f", "__w").agg(F.max("__n").alias("__n"))
    least = F.coalesce(F.min(F.when(F.col("__n") <= MOST, F.col("__f"))), F.lit(max(FINER)))
    return held.groupBy(*block).agg((F.first("__w") / F.pow(F.lit(2.0), least)).alias("__w"))


def nearest(treated: DataFrame, controls: DataFrame, block: list[str], u: list[str], distance: Column, n: int = 1, data: list[str] | None = None, eligible: Column | None = None, penalty: float = 0.0, pairs: list | None = None) -> DataFrame:
    """id, block, control, distance, control_rank: the n nearest eligible controls of each treated unit, ties to the least id.

    Both tables: id, block, u (coordinates) and data (what distance and eligible read, as t.<name> and c.<name>).
    distance squared is at least the squared distance of coordinates, and at most that plus the penalty. A unit is no
    control of itself. Rows with a missing block or coordinate have no neighbours. pairs: a list that
    gets the number of pairs compared in each step (by a job of its own).
    """
    own = [*block, *dict.fromkeys([*u, *(data or [])])]
    t, c = (x.select("id", *own).dropna(subset=["id", *block, *u]) for x in (treated, controls))
    first = Window.partitionBy(*own).orderBy("id")
    c = stage(c.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n + 1).drop("__r"), "controls")
    points = stage(t.groupBy(*own).agg(F.min("id").alias("__p")), "points")
    size = points.groupBy(*block).agg(F.count("*").alias("__nt")).join(c.groupBy(*block).agg(F.count("*").alias("__nc")), block)
    size = stage(size.select(*block, (F.col("__nt") * F.col("__nc") <= DIRECT).alias("__small")), "blocks")
    d, want = len(u), n + 1
    best = Window.partitionBy("__p").orderBy("__d", "__c")

    def compared(met: DataFrame) -> DataFrame:
        """__p, __c, __d: the first of the pairs that meet."""
        if eligible is not None:
            met = met.where(eligible)
        met = met.select(F.col("t.__p").alias("__p"), F.col("c.id").alias("__c"), distance.alias("__d"))
        if pairs is not None:
            pairs.append(met.count())
        return met.where("__d is not null").withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= want).drop("__r")

    on = lambda keys: [F.col(f"t.{k}") == F.col(f"c.{k}") for k in keys]
    found = compared(points.join(size.where("__small").select(*block), block).alias("t").join(c.alias("c"), on(block)))
    large = size.where("not __small").select(*block)
    if not large.isEmpty():
        c = c.join(large, block)
        widths = stage(first_widths(c, block, u), "widths")
        c, left = stage(c.join(widths, block), "controls"), stage(points.join(widths, block), "points")
        keys = [*block, *(f"__i{k}" for k in range(d))]
        for r in range(ROUNDS):
            width = F.col("__w") * (2.0**r)
            around = F.inline(F.array(*[F.struct(*[(F.floor(F.col(x) / width).cast("long") + o).alias(f"__i{k}") for k, (x, o) in enumerate(zip(u, step, strict=True))]) for step in itertools.product((-1, 0, 1), repeat=d)]))
            met = left.select("*", around).alias("t").join(c.select("*", *_cells(u, width)).alias("c"), on(keys))
            got = stage(compared(met), "near")
            last = got.groupBy("__p").agg(F.count("*").alias("__n"), F.max("__d").alias("__far")).join(left.select("__p", "__w"), "__p")
            done = last.where((F.col("__n") >= want) & (F.col("__far") * (1 + SPARE) <= width)).select("__p")
            found = found.unionByName(got.join(done, "__p", "left_semi"))
            left = stage(left.join(done, "__p", "left_anti"), "left")
            if left.isEmpty():
                break
        else:
            found = found.unionByName(compared(_opened(left, c, block, u, want, penalty, eligible is not None, on, keys)))
    # back from points to units; a unit is dropped from its own list
    named = t.join(points.select("__p", *own), own).select("id", *block, "__p")
    out = named.join(found, "__p").where(F.col("id") != F.col("__c"))
    out = out.withColumn("control_rank", F.row_number().over(Window.partitionBy("id", *block).orderBy("__d", "__c"))).where(F.col("control_rank") <= n)
    return out.select("id", *block, F.col("__c").alias("control"), F.col("__d").alias("distance"), "control_rank")


def _opened(left: DataFrame, c: DataFrame, block: list[str], u: list[str], want: int, penalty: float, partial: bool, on, keys: list[str]) -> DataFrame:
    """Pairs t, c of far points with the controls of all cells that can hold one of their first `want` neighbours.

    A cell's box says how near and how far its controls are at most; so many nearest boxes as hold enough controls bound
    the last neighbour. With a condition on pairs (partial) the boxes' numbers tell nothing, and all cells are opened.
    """
    left = dealt(left, "__p")  # few rows, each of which meets all boxes of its block
    held = c.select("*", *_cells(u, F.col("__w")))
    boxes = held.groupBy(*keys).agg(F.count("*").alias("__n"), *[f(x).alias(f"__{f.__name__}{k}") for k, x in enumerate(u) for f in (F.min, F.max)])
    j = left.alias("t").join(boxes.alias("c"), on(block))
    low, high = (lambda k: F.col(f"c.__min{k}")), (lambda k: F.col(f"c.__max{k}"))
    at = lambda k: F.col(f"t.{u[k]}")
    total = lambda parts: F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    near = total([F.greatest(low(k) - at(k), at(k) - high(k), F.lit(0.0)) for k in range(len(u))])
    far = F.sqrt(F.pow(total([F.greatest(F.abs(low(k) - at(k)), F.abs(high(k) - at(k))) for k in range(len(u))]), F.lit(2.0)) + penalty)
    j = j.select(F.col("t.__p").alias("__p"), *[F.col(f"c.{k}").alias(k) for k in keys], F.col("c.__n").alias("__n"), near.alias("__near"), far.alias("__far"))
    if partial:
        opened = j
    else:
        enough = F.sum("__n").over(Window.partitionBy("__p").orderBy("__far", *keys).rowsBetween(Window.unboundedPreceding, 0)) >= want
        limit = j.withColumn("__ok", enough).groupBy("__p").agg(F.coalesce(F.min(F.when(F.col("__ok"), F.col("__far"))), F.lit(math.inf)).alias("__limit"))
        opened = j.join(limit, "__p").where(F.col("__near") <= F.col("__limit") * (1 + SPARE))
    wanted = opened.select("__p", *[k for k in keys if k not in block]).join(left, "__p")
    return wanted.alias("t").join(held.alias("c"), on(keys))
