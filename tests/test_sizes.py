"""Steps must not send whole tables to the driver, nor gather many partitions in one task."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from panelkit.operators import accounting, docs, estimators, matching, moves, panels, quantiles, resample, similarity
from panelkit.operators.placebos import wide_placebos
from panelkit.plans import domain, tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_of_customers_is_not_broadcast(spark):
    p = domain.panel_roles(spark, SF)
    assert "Broadcast" not in plan(p.where("g > 0").groupBy("id").agg(F.min("g")))
    wide = wide_placebos(p, ["y"], "id", "year", {"urgent": "g_urgent"}, "g", 1, -5, 5, -1, 42)
    joins = [line for line in plan(wide).splitlines() if "BroadcastHashJoin" in line]
    assert all("__c" in line for line in joins)  # the counts of cells of the ranks
    rows = p.groupBy("id").agg(F.count("*").alias("n"), F.sum("n_orders").alias("orders"))
    orders = spark.read.parquet(f"{SF}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("want"))
    assert rows.join(orders, "id", "left").where("n <> 7 OR orders <> coalesce(want, 0)").count() == 0


def test_wild_band_makes_one_row_a_draw_and_entity(spark):
    effects = spark.createDataFrame([(e, k, 1, float(e * k % 7)) for e in range(20) for k in range(5)], "id long, k long, d int, tau double")
    got = resample.wild_band(effects, "id", "d", draws=30)
    assert not re.search(r"keys=\[k#\d+L?, b#\d+", plan(got))
    rows = {r["k"]: r for r in got.collect()}
    assert sorted(rows) == list(range(5)) and rows[0]["lo"] == rows[0]["hi"] == 0.0
    assert all(r["lo"] < r["att"] < r["hi"] for k, r in rows.items() if k)
    assert resample.wild_band(effects.where("id < 0"), "id", "d", draws=30).collect() == []


def test_rolling_self_similarity_joins_nothing_and_deals_by_entity(spark):
    rows = spark.createDataFrame([(1, 2000, "a"), (1, 2000, "b"), (1, 2001, "a"), (1, 2004, "a"), (2, 2000, "a"), (2, 2002, "b"), (None, 2000, "a")], "e long, y long, c string")
    got = similarity.rolling_self_similarity(rows, "e", "y", "c", 2)
    assert "Join" not in plan(got) and plan(got).count("Exchange") == plan(got).count("REPARTITION_BY_NUM") == 1
    assert sorted((r["e"], r["y"], round(r["similarity"], 6)) for r in got.collect()) == [(1, 2001, 0.707107), (2, 2002, 0.0)]


def test_balanced_events_are_dealt_by_key_and_not_broadcast(spark):
    panel = spark.createDataFrame([(i, y, float(y)) for i in range(6) for y in range(1995, 2002)], "id long, year long, v double")
    events = spark.createDataFrame([(0, 1998), (1, 2000), (2, 1997)], "id long, g long")
    got = panels.balanced_event_panel(panel, events, "id", "year", "g", -2, 2, ["v"], [])
    assert "Broadcast" not in plan(got) and "REPARTITION_BY_NUM" in plan(got)
    assert got.count() == 10 and got.where("v <> g + k").count() == 0


def test_entity_years_are_dealt_by_unit(spark):
    rows = spark.createDataFrame([(1, 2000, 7, 10, 1.0), (1, 2002, 8, 11, 2.0), (None, 2000, 7, 12, 3.0), (2, None, 7, 13, 4.0)], "u long, y long, f long, d long, v double")
    got = panels.entity_year_panel(rows, "u", "y", "f", {"n": "d"}, ["v"], [])
    assert "REPARTITION_BY_NUM" in plan(got)
    assert sorted((r["u"], r["y"], r["n"], r["sum_v"], r["firm_assigned"]) for r in got.collect()) == [(1, 2000, 1, 1.0, 7), (1, 2001, 0, 0.0, 7), (1, 2002, 1, 2.0, 8)]


def test_exploration_joins_nothing(spark):
    rows = spark.createDataFrame([(1, 2000, "a", 5), (2, 2001, "a", 5), (2, 2001, "b", 5), (3, 2001, "a", None), (4, 2009, "a", 5)], "d long, y long, c string, p long")
    got = docs.exploration(rows, "d", "y", "c", "p", 2)
    assert "Join" not in plan(got) and "REPARTITION_BY_NUM" in plan(got)
    assert {r["d"]: r["exploration"] for r in got.collect()} == {1: 1.0, 2: 0.5, 3: 1.0, 4: 1.0}


def test_careers_are_dealt_by_document_and_person(spark):
    rows = spark.createDataFrame([(1, 2000, "a", 5), (1, 2000, "a", 6), (2, 2002, "b", 5), (3, 2001, "a", None)], "d long, y long, c string, p long")
    got = docs.career(rows, "p", "d", "y", "c", ["y", "d"])
    assert plan(got).count("REPARTITION_BY_NUM") >= 3
    assert sorted((r["d"], r["p"] or 0, r["team_size"], r["first_class"], r["age"], r["same_first_class"]) for r in got.collect()) == [(1, 5, 2, "a", 0, 1), (1, 6, 2, "a", 0, 1), (2, 5, 1, "a", 2, 0), (3, 0, 0, None, None, 0)]


def test_stable_moves_are_dealt_by_unit(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate("aabbb")] + [(None, i, s) for i, s in enumerate("aabbb")], "u long, t int, s string")
    got = moves.stable_moves(rows, "u", "s", ["t"])
    assert "REPARTITION_BY_NUM" in plan(got)
    assert [tuple(r) for r in got.collect()] == [(1, 2, "a", "b")]


def test_moves_take_five_rows_without_a_count(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i, s, "x") for i, s in enumerate("aabb")] + [(2, i, s, "x") for i, s in enumerate("aabbb")], "u long, t int, s string, other string")
    got = moves.stable_moves(rows, "u", "s", ["t"])
    assert "Join" not in plan(got) and plan(got).count("REPARTITION_BY_NUM") == 1
    assert [tuple(r) for r in got.collect()] == [(2, 2, "a", "b")]
    assert moves.stable_moves(rows, "u", "s", ["t"], 6).collect() == []
    staged, stage = {}, domain.stage
    monkeypatch.setattr(domain, "stage", lambda df, name="stage": staged.setdefault(name, stage(df, name)))
    domain.moves_and_rows(spark, SF)
    assert plan(domain.docs(spark, SF)).count("REPARTITION_BY_NUM") == 2
    assert staged["segment-rows"].columns == ["person", "state", *domain.MOVE_ORDER, "ship_year"]


def test_band_of_synthetic_controls_makes_no_row_a_draw_and_unit(spark):
    gaps = spark.createDataFrame([(u, k, float(u * (k + 2) % 5)) for u in range(9) for k in range(-1, 3) if u or k < 2], "id long, k long, gap double")
    got = resample.scm_band(gaps, "id", 40, hi=1)
    assert "Join" not in plan(got)
    w = resample.drawn_units(gaps.select(F.col("id").alias("u")).distinct(), 40, 42).join(gaps, F.col("u") == F.col("id"))
    for k, on in {0: "k = 0", 2: "k = 2", None: "k BETWEEN 0 AND 1"}.items():
        want = w.where(on).groupBy("b").agg((F.sum(F.col("gap") * F.col("w")) / F.sum("w")).alias("a")).agg(F.percentile("a", F.lit(0.025)), F.percentile("a", F.lit(0.975))).first()
        row = got.where(F.col("k").eqNullSafe(F.lit(k))).first()
        assert abs(row["lo"] - want[0]) < 1e-9 and abs(row["hi"] - want[1]) < 1e-9


def test_synthetic_controls_start_settled_on_a_block_of_donors(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, t, float(v), 6 * (i < 5)) for i in range(60) for t, v in enumerate(r.normal(size=9).cumsum())]
    names, stage = [], estimators.stage
    monkeypatch.setattr(estimators, "stage", lambda df, name="stage": names.append(name) or stage(df, name))
    got = estimators.synthetic_control(spark.createDataFrame(rows, "id long, year long, y double, g long"), "y", "id", "year", "g", min_post=2)
    assert got.select("id").distinct().count() == 5
    assert names.count("dual") == 2  # the start, and one pass that finds all of them settled


def test_cohorts_are_matched_on_the_rows_of_the_year_before(spark, monkeypatch):
    rows = [(i, y, (0, 0, 1995, 1998)[i % 4], "b", float(i % 7), float(i * i % 11)) for i in range(40) for y in range(1995, 2002)]
    staged, stage = [], matching.stage
    monkeypatch.setattr(matching, "stage", lambda df, name="stage": staged.append((name, stage(df, name))) or staged[-1][1])
    got = matching.match_cohorts(spark.createDataFrame(rows, "id long, year long, g long, b string, x double, z double"), "id", "year", "g", "b", "x", "z")
    assert got.count() == 10 and {r["cohort"] for r in got.collect()} == {1998}
    assert [(n, df.count()) for n, df in staged] == [("cohorts", 20 * 7 + 10), ("pool", 30), ("pairs", 10)]  # none for 1995, whose year before is not there
    none = matching.match_cohorts(spark.createDataFrame(rows[:14], "id long, year long, g long, b string, x double, z double"), "id", "year", "g", "b", "x", "z")
    assert none.schema == got.schema and none.count() == 0


def test_rolling_similarity_makes_vectors_once_for_all_moves(spark, monkeypatch):
    r = np.random.default_rng(4)
    data = [(int(u), "abc"[s], int(y), "xyz"[c]) for u, s, y, c in zip(r.integers(0, 4, 80), r.integers(0, 3, 80), r.integers(2000, 2008, 80), r.integers(0, 3, 80))]
    rows = spark.createDataFrame(data, "u long, s string, y long, c string")
    moves = [(u, f, t) for u in range(4) for f in "abc" for t in "abc" if f != t]
    staged, stage = {}, similarity.stage
    monkeypatch.setattr(similarity, "stage", lambda df, name="stage": staged.setdefault(name, stage(df, name)))
    active = {(u, y) for u, _, y, _ in data}
    for history in ("active", "all"):
        staged.clear()
        got = {(x["u"], x["from_state"], x["to_state"], x["y"]): x for x in similarity.rolling_similarity(spark.createDataFrame(moves, "u long, from_state string, to_state string"), rows, "u", "s", "y", "c", 2, history).collect()}
        assert got.keys() == {(u, f, t, y) for u, f, t in moves for a, y in active if a == u}
        assert staged["places"].count() == staged["places"].select("u", "p", "at").distinct().count() <= 4 * 3 * 10  # units, places and years, not moves
        for (u, f, _, y), x in got.items():
            now, hist, place = (np.array([sum(on(*d) and d[3] == c for d in data) for c in "xyz"], float) for on in (
                lambda v, s, at, c: v == u and at == y, lambda v, s, at, c: v == u and y - 2 <= at < y,
                lambda v, s, at, c: s == f and y - 2 <= at < y and (history == "all" or (u, at) in active)))
            for name, a, b in (("inv_self", now, hist), ("inv_from", now, place), ("hist_from", hist, place)):
                assert x[name] is None if not a.any() or not b.any() else abs(x[name] - a @ b / np.sqrt(a @ a * (b @ b))) < 1e-9


def test_peers_are_counted_once_a_mover_and_firm(spark, monkeypatch):
    rows = spark.createDataFrame([(u, f, y, 10 * y + d, float(u + y)) for u in range(3) for f in "ab" for y in (1, 2, 3) for d in range(u + 1)], "u long, f string, y long, d long, v double")
    events = spark.createDataFrame([(0, 2, "a", "b"), (0, 2, "b", "a"), (0, 2, "a", "c")], "u long, move_year long, from_state string, to_state string")
    staged, stage = {}, moves.stage
    monkeypatch.setattr(moves, "stage", lambda df, name="stage": staged.setdefault(name, stage(df, name)))
    got = moves.peer_benchmark(events, rows, "u", "f", "y", "d", "v", 2)
    assert staged["units"].count() == 3 and "REPARTITION_BY_NUM" in plan(got)
    x = {(r["from_state"], r["to_state"]): r for r in got.collect()}
    assert len(x) == 3 and x["a", "c"]["mover_docs_dest_post"] == x["a", "c"]["peers_docs_dest_post"] == 0
    one = x["a", "b"]
    assert (one["mover_origin_pre"], one["peers_origin_pre"], one["mover_docs_origin_pre"], one["peers_docs_origin_pre"]) == (1.0, 13 / 5, 1, 3)
    assert (one["mover_docs_dest_post"], one["peers_docs_dest_post"]) == (2, 6)


def test_statements_are_shuffled_once_and_written_once(spark, monkeypatch):
    raw, cpi = tables.statements(spark, SF), tables.price_index(spark, SF)
    x = accounting.fundamentals(raw, cpi, winsorised=False, keep=["gvkey", "data_year", "leverage", "isg"])
    text = plan(x)
    assert "SortMergeJoin" not in text and text.count("REPARTITION_BY_NUM") == 2  # the statements, and what industry growth takes of them
    staged = []
    for module in (accounting, quantiles):
        monkeypatch.setattr(module, "stage", lambda df, name="stage", stage=module.stage: staged.append((name, df.columns)) or stage(df, name))
    got = accounting.fundamentals(raw, cpi, keep=["gvkey", "data_year", "leverage", "roa"])
    assert staged == [("fundamentals", ["gvkey", "data_year", "leverage", "roa"])]
    whole = accounting.fundamentals(raw, cpi).select(got.columns)
    assert got.count() > 100 and sorted(got.collect(), key=str) == sorted(whole.collect(), key=str)


def test_documents_of_movers_and_teams_are_dealt_alike(spark):
    rows = spark.createDataFrame([(u, f, y, 10 * y + d, float(u + y)) for u in range(3) for f in "ab" for y in (1, 2, 3) for d in range(u + 1)], "u long, f string, y long, d long, v double")
    events = spark.createDataFrame([(0, 2, "a", "b"), (0, 2, "b", "a")], "u long, move_year long, from_state string, to_state string")
    got = moves.peer_benchmark(events, rows, "u", "f", "y", "d", "v", 2)
    assert plan(got).count("REPARTITION_BY_NUM") == 3  # teams of all firms, documents of movers, and the teams that they meet
    assert {r["mover_docs_dest_post"] for r in got.collect()} == {2}


def test_synthetic_controls_settle_over_several_blocks_of_donors(spark, monkeypatch):
    """Four blocks: one pass after the start, as units settle over all of them in one task; a unit's years are one row."""
    r = np.random.default_rng(4)
    rows = [(i, t, float(v), 6 * (i < 5)) for i in range(60) for t, v in enumerate(r.normal(size=9).cumsum())]
    df, names, stage = spark.createDataFrame(rows, "id long, year long, y double, g long"), [], estimators.stage
    want = {(x["id"], x["k"]): x["gap"] for x in estimators.synthetic_control(df, "y", "id", "year", "g", min_post=2).collect()}
    monkeypatch.setattr(estimators, "stage", lambda d, name="stage": names.append((name, d.count() if name == "scm" else 0)) or stage(d, name))
    monkeypatch.setattr(estimators, "DONORS", 16)
    got = {(x["id"], x["k"]): x["gap"] for x in estimators.synthetic_control(df, "y", "id", "year", "g", min_post=2).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)
    assert names.count(("dual", 0)) == 2 and ("scm", 60) in names
    monkeypatch.setattr(estimators, "HELD", 2)  # what is not held is met in passes
    got = {(x["id"], x["k"]): x["gap"] for x in estimators.synthetic_control(df, "y", "id", "year", "g", min_post=2).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_draws_of_synthetic_controls_are_summed_once(spark, monkeypatch):
    """The band reads a table of sums by draw and period: no Python step is left in its plan, let alone two."""
    gaps = spark.createDataFrame([(u, k, float(u * (k + 2) % 5)) for u in range(9) for k in range(-1, 3)], "id long, k long, gap double")
    assert "FlatMapGroupsInPandas" not in plan(resample.scm_band(gaps, "id", 40, hi=1))
