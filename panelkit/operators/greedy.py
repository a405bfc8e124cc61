"""Greedy matching on a score in the order of ids, without a list of candidate pairs.

Each exact cell is cut into strips of the score. A task walks the units of one strip over the controls of its window:
the strip and some on both sides. What units of other strips hold there is taken from the round before, and a strip is
walked again when that changed, or when a unit of it may have nearer controls outside the window. When nothing changes
any more, each unit has what the walk of the whole cell gives it: the unit with the least id hangs on no other, and each
next one only on those before it. A cell of one strip takes one round.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import stage

#: Units and controls of a strip, about; those of one score are never parted.
STRIP = 250_000


def _found(link: list[int], i: int) -> int:
    """Where the links from i end; those on the way are shortened."""
    while link[i] != i:
        link[i] = i = link[link[i]]
    return i


class _Controls:
    """Controls in order of score and id, of which the full ones are passed over."""

    def __init__(self, ids: list, scores: np.ndarray, most: int):
        first = np.r_[True, scores[1:] != scores[:-1]][: len(ids)]
        self.ids, self.most, self.used = ids, most, [0] * len(ids)
        self.points, self.point_of = scores[first].tolist(), (np.cumsum(first) - 1).tolist()
        self.starts = [*np.flatnonzero(first).tolist(), len(ids)]
        self.after = list(range(len(ids) + 1))  # the next control that is not full
        self.right, self.left = (list(range(len(self.points) + 1)) for _ in range(2))  # the next point with one; left[p + 1]: to the left

    def take(self, i: int) -> None:
        self.used[i] += 1
        if self.used[i] == self.most:
            self.after[i], p = i + 1, self.point_of[i]
            if _found(self.after, self.starts[p]) >= self.starts[p + 1]:
                self.right[p], self.left[p + 1] = p + 1, p

    def at(self, p: int):
        """(id, place) of the controls of a point."""
        i = _found(self.after, self.starts[p])
        while i < self.starts[p + 1]:
            yield self.ids[i], i
            i = _found(self.after, i + 1)

    def near(self, x: float, place: int, caliper: float):
        """(distance, id, place) of the controls in order of distance and id; place: of the first point above x."""
        points, end = self.points, len(self.points)
        lo, hi = _found(self.left, place), _found(self.right, place)
        while lo > 0 or hi < end:
            d = min(x - points[lo - 1] if lo > 0 else math.inf, points[hi] - x if hi < end else math.inf)
            if d > caliper:
                return
            level = []
            while lo > 0 and x - points[lo - 1] == d:
                level.append(lo - 1)
                lo = _found(self.left, lo - 1)
            while hi < end and points[hi] - x == d:
                level.append(hi)
                hi = _found(self.right, hi + 1)
            for cid, i in self.at(level[0]) if len(level) == 1 else heapq.merge(*map(self.at, level)):
                yield d, cid, i


def match_scores(treated: DataFrame, controls: DataFrame, exact: list[str], score: str, caliper: float | None, spans: list[tuple[str, float]], n: int = 3, max_reuse: int = 10) -> DataFrame:
    """tid, cid, exact columns, control_rank, dist: match_greedy over candidates, which are not spelled out.

    Both tables: id, the exact columns, the score and the columns of spans; rows that lack one match nothing. Treated
    units take, in order of ids, the n nearest controls of their cell (ties to the least id) within caliper and
    tolerances that fewer than max_reuse units took before.
    """
    reach, own = math.inf if caliper is None else caliper, [x for x, _ in spans]
    keys = exact or ["__cell"]
    side = lambda df: df.select("id", *[F.col(k) if exact else F.lit(0).alias(k) for k in keys], F.col(score).cast("double").alias("__s"), *[F.col(x).alias(f"__x{i}") for i, x in enumerate(own)]).dropna().distinct()
    t, c = stage(side(treated), "units"), stage(side(controls), "controls")
    most = t.unionByName(c).groupBy(*keys).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
    many = -(-most // STRIP) > 1
    if many:
        k = -(-most // STRIP)
        cuts = t.unionByName(c).groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__s", [i / k for i in range(1, k)]).alias("__cuts"))
        cuts = stage(cuts.where(F.col("__n") > STRIP).select(*keys, F.array_distinct("__cuts").alias("__cuts")), "cuts")
        none = F.array().cast("array<double>")
        strip = lambda df, name: df.join(cuts, keys, "left").withColumn("__cuts", F.coalesce("__cuts", none)).withColumn(name, F.size(F.filter("__cuts", lambda v: v <= F.col("__s"))))
        t, c = stage(strip(t, "__home"), "units"), stage(strip(c, "__at").drop("__cuts"), "controls")
        strips = stage(t.select(*keys, "__home", "__cuts").distinct().withColumn("__w", F.lit(1)), "strips")
        t = t.drop("__cuts")
    else:
        t, c = t.withColumn("__home", F.lit(0)), c.withColumn("__at", F.lit(0))
    kinds = dict(t.dtypes)
    cell = [*keys, "__home"]
    columns = ["tid", "cid", *cell, "__at", "control_rank", "dist"]
    schema = ", ".join(f"`{x}` {y}" for x, y in zip(columns, [kinds["id"], dict(c.dtypes)["id"], *(kinds[k] for k in cell), "int", "int", "double"], strict=True))

    def walk(u, d):
        """The picks of a strip; a row without units where one of them may have nearer controls outside the window."""
        import pandas as pd

        u, d = u.sort_values("id"), d.sort_values(["__s", "id"])
        scores = d["__s"].to_numpy()
        left = _Controls(d["id"].tolist(), scores, max_reuse)
        held = sorted((tid, i) for i, x in enumerate(d["__held"]) if x is not None for tid in x)
        places = np.searchsorted(np.array(left.points), u["__s"].to_numpy(), side="right").tolist()
        limits = [(u[f"__x{j}"].tolist(), d[f"__x{j}"].tolist(), tolerance) for j, (_, tolerance) in enumerate(spans)]
        low, high = (u["__low"].iloc[0], u["__high"].iloc[0]) if len(u) else (0, 0)
        picks, next_held, short = [], 0, False
        for j, (tid, x, place) in enumerate(zip(u["id"].tolist(), u["__s"].tolist(), places, strict=True)):
            while next_held < len(held) and held[next_held][0] < tid:
                left.take(held[next_held][1])
                next_held += 1
            taken, far = 0, reach
            for dist, cid, i in left.near(x, place, reach):
                if cid != tid and all(abs(mine[j] - its[i]) <= tolerance for mine, its, tolerance in limits):
                    left.take(i)
                    taken += 1
                    picks.append((j, i, taken, dist))
                    if taken == n:
                        far = dist
                        break
            edge = min(x - low, high - x)
            short = short or not (far < edge or edge == math.inf)
        js, at, ranks, dists = (list(v) for v in zip(*picks, strict=True)) if picks else ([], [], [], [])
        out = u.iloc[js][["id", *cell]].rename(columns={"id": "tid"}).reset_index(drop=True)
        out = out.assign(cid=d["id"].to_numpy()[at], control_rank=ranks, dist=dists, **{"__at": d["__at"].to_numpy()[at]})[columns]
        return pd.concat([out.astype(object), u.iloc[:1][cell]]) if short else out

    def walked(todo: DataFrame, picks: DataFrame | None) -> DataFrame:
        """The picks of the strips of todo; those of other strips stand as picks tells."""
        window = stage(todo.select(*cell, F.explode(F.sequence(F.col("__home") - F.col("__w"), F.col("__home") + F.col("__w"))).alias("__at")), "windows")
        seen = c.join(window, [*keys, "__at"])
        if picks is None:
            seen = seen.withColumn("__held", F.lit(None).cast(f"array<{kinds['id']}>"))
        else:
            others = picks.withColumnRenamed("__home", "__by").join(window, [*keys, "__at"]).where("__by <> __home")
            seen = seen.join(others.groupBy(*cell, F.col("cid").alias("id")).agg(F.collect_list("tid").alias("__held")), [*cell, "id"], "left")
        first, last = F.col("__home") - F.col("__w"), F.col("__home") + F.col("__w")
        edge = lambda inside, at, beyond: F.when(inside, F.get("__cuts", at)).otherwise(F.lit(beyond))
        edges = todo.select(*cell, edge(first > 0, first - 1, -math.inf).alias("__low"), edge(last < F.size("__cuts"), last, math.inf).alias("__high"))
        return stage(t.join(edges, cell).groupBy(*cell).cogroup(seen.groupBy(*cell)).applyInPandas(walk, schema), "picks")

    result = ["tid", "cid", *exact, "control_rank", "dist"]
    if not many:
        whole = t.withColumns({"__low": F.lit(-math.inf), "__high": F.lit(math.inf)})
        seen = c.withColumns({"__home": F.lit(0), "__held": F.lit(None).cast(f"array<{kinds['id']}>")})
        return stage(whole.groupBy(*cell).cogroup(seen.groupBy(*cell)).applyInPandas(walk, schema), "picks").select(*result)
    new = walked(strips, None)
    picks, moved = new.where("tid is not null"), new.where("tid is not null").select(*cell, "__at")
    strips = stage(strips.where(F.size("__cuts") > 0), "strips")
    while True:
        short = stage(new.where("tid is null").select(*cell, F.lit(True).alias("__short")), "short")
        strips = stage(strips.join(short, cell, "left").withColumn("__w", F.when(F.col("__short"), 2 * F.col("__w")).otherwise(F.col("__w"))).drop("__short"), "strips")
        met = strips.join(moved.select(*keys, F.col("__home").alias("__by"), "__at").distinct(), keys).where((F.col("__by") != F.col("__home")) & (F.abs(F.col("__at") - F.col("__home")) <= F.col("__w")))
        todo = stage(strips.join(met.select(*cell).union(short.select(*cell)).distinct(), cell), "todo")
        if todo.isEmpty():
            return picks.select(*result)
        new = walked(todo, picks)
        now, before = new.where("tid is not null"), picks.join(todo.select(*cell), cell, "left_semi")
        moved = stage(now.select(*columns).exceptAll(before.select(*columns)).union(before.select(*columns).exceptAll(now.select(*columns))).select(*cell, "__at").distinct(), "moved")
        picks = stage(picks.join(todo.select(*cell), cell, "left_anti").select(*columns).union(now.select(*columns)), "picks")
