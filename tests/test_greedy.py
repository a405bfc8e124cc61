"""Greedy matching on a score without candidate pairs, against a walk of all candidates in order of ids."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from panelkit.operators import greedy, matching


def walk(treated, controls, caliper, tolerance, n, most):
    used, out = Counter(), []
    for tid, e, s, x in sorted(treated):
        near = sorted((abs(s - cs), cid) for cid, ce, cs, cx in controls if ce == e and cid != tid and (caliper is None or abs(s - cs) <= caliper) and abs(x - cx) <= tolerance and used[cid, e] < most)
        for rank, (dist, cid) in enumerate(near[:n], 1):
            used[cid, e] += 1
            out.append((tid, cid, e, rank, dist))
    return sorted(out)


def _rows(seed, n_treated, n_controls, grid):
    r = random.Random(seed)
    row = lambda i: (i, r.choice("aab"), r.choice([0.25, round(r.random(), grid)]) if grid < 9 else r.random(), float(r.randrange(4)))
    ids = r.sample(range(10_000), n_treated + n_controls)
    return [row(i) for i in ids[:n_treated]], [row(i) for i in ids[n_treated:]]


@pytest.mark.parametrize(("strip", "grid", "caliper"), [(250_000, 2, 0.05), (60, 9, 0.05), (60, 2, 0.3), (40, 9, None)])
def test_picks_are_those_of_the_walk(spark, monkeypatch, strip, grid, caliper):
    monkeypatch.setattr(greedy, "STRIP", strip)
    t, c = _rows(strip + grid, 120, 160, grid)
    schema = "id long, e string, s double, x double"
    got = greedy.match_scores(spark.createDataFrame(t, schema), spark.createDataFrame(c, schema), ["e"], "s", caliper, [("x", 1)], 3, 2)
    assert sorted(map(tuple, got.select("tid", "cid", "e", "control_rank", "dist").collect())) == walk(t, c, caliper, 1, 3, 2)


def test_no_candidate_pairs_are_written(spark, monkeypatch):
    """400 units that all meet all 400 controls: 160,000 pairs."""
    staged, stage = [], greedy.stage
    monkeypatch.setattr(greedy, "stage", lambda df, name: staged.append(stage(df, name)) or staged[-1])
    rows = [(i, "a", 0.5 + (i % 7) / 1000, 1.0) for i in range(800)]
    schema = "id long, e string, s double, x double"
    t, c = spark.createDataFrame(rows[::2], schema), spark.createDataFrame(rows[1::2], schema)
    got = greedy.match_scores(t, c, ["e"], "s", 0.05, [("x", 2)], 3, 2)
    assert sorted(map(tuple, got.collect())) == walk(rows[::2], rows[1::2], 0.05, 2, 3, 2)
    assert sum(df.count() for df in staged) <= 4 * len(rows)
    monkeypatch.setattr(matching, "WALK", 10_000)
    old = matching.match_greedy(matching.candidates(t, c, ["e"], "s", 0.05, [("x", 2)]), ["e"], 3, 2)
    assert sorted(map(tuple, old.select(*got.columns).collect())) == sorted(map(tuple, got.collect()))


def test_nothing_to_match(spark):
    schema = "id long, e string, s double, x double"
    some, none = spark.createDataFrame([(1, "a", 0.5, 1.0), (2, None, 0.5, 1.0), (3, "a", None, 1.0)], schema), spark.createDataFrame([], schema)
    for t, c in ((some, none), (none, some), (none, none), (some, some)):
        assert greedy.match_scores(t, c, ["e"], "s", 0.05, [("x", 2)]).collect() == []
