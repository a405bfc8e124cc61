import random

import numpy as np
import pandas as pd
import pytest
from panelkit.functions import nulls, scalars
from panelkit.operators import diagnostics, docs, estimators, hetero, joins, matching, moves, panels, resample, windows
from panelkit.operators.gram import fe_ols
from pyspark.sql import functions as F


def simulated(n=60, years=8, seed=0, effect=lambda g, k: 1.0, drop=0.0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = int(r.choice([0, 3, 5]))
        a = r.normal()
        for t in range(1, years + 1):
            if r.random() < drop:
                continue
            d = int(g > 0 and t >= g)
            x = r.normal()
            rows.append((i, t, a + 0.3 * t + 0.5 * x + (effect(g, t - g) if d else 0) + r.normal() * 0.01, x, g, d, t - g if g else None, f"b{i % 3}"))
    return pd.DataFrame(rows, columns=["id", "year", "y", "x", "g", "d", "k", "block"])


SCHEMA = "id long, year long, y double, x double, g long, d long, k long, block string"


def frame(spark, p):
    rows = [(int(r.id), int(r.year), float(r.y), float(r.x), int(r.g), int(r.d), None if pd.isna(r.k) else int(r.k), r.block) for r in p.itertuples()]
    return spark.createDataFrame(rows, SCHEMA)


def dense(p, cols, cov):
    """Dummy-variable least squares."""
    e, t = pd.factorize(p["id"])[0], pd.factorize(p["year"])[0]
    z = np.column_stack([p[cols].to_numpy(float), np.eye(e.max() + 1)[e], np.eye(t.max() + 1)[t][:, 1:]])
    y = p["y"].to_numpy()
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    u, inv = y - z @ b, np.linalg.pinv(z.T @ z)
    score = z * u[:, None]

    def meat(key):
        s = pd.DataFrame(score).groupby(key).sum().to_numpy()
        return s.T @ s

    m = {"entity": meat(e), "time": meat(t), "robust": score.T @ score}
    m["twoway"] = m["entity"] + m["time"] - m["robust"]
    v = inv @ m[cov] @ inv
    k = len(cols)
    return b[:k], np.sqrt(np.diag(v)[:k])


@pytest.mark.parametrize("cov", ["entity", "time", "twoway", "robust"])
def test_fixed_effects_equal_dummy_regression(spark, cov):
    p = simulated(drop=0.2)
    fit = fe_ols(frame(spark, p).repartition(3), "y", ["d", "x"], "id", "year", cov)
    b, se = dense(p, ["d", "x"], cov)
    assert np.allclose(fit.beta, b, atol=1e-8) and np.allclose(fit.se(), se, atol=1e-8) and fit.nobs == len(p)


def test_absorbed_and_missing(spark):
    d = frame(spark, simulated()).withColumns({"c": F.col("id").cast("double"), "x2": F.col("x") * 2, "bad": F.when(F.col("id") == 1, float("nan")).otherwise(F.col("x"))})
    fit = fe_ols(d, "y", ["d", "x", "x2", "c"], "id", "year")
    assert fit.names == ["d", "x"] and fit.absorbed == ["x2", "c"]
    assert fe_ols(d, "y", ["bad"], "id", "year").nobs == fit.nobs - 8
    assert fe_ols(d.limit(0), "y", ["d"], "id", "year").status == "no rows"


def test_cohort_estimators_recover_what_differs(spark):
    effect = lambda g, k: (2.0 if g == 3 else 1.0) + 0.5 * k
    d = frame(spark, simulated(240, effect=effect)).withColumn("y", F.col("y") - 0.5 * F.col("x"))
    p = d.toPandas()
    n3, n5 = p[p.g == 3].id.nunique(), p[p.g == 5].id.nunique()
    want = {k: (n3 * (2 + 0.5 * k) + n5 * (1 + 0.5 * k)) / (n3 + n5) for k in range(3)}
    sa = {r["k"]: r["coef"] for r in estimators.sun_abraham(d, "y", "id", "year", "g", -4, 5).collect()}
    cs = {r["k"]: r["att"] for r in estimators.att_dynamic(estimators.att_gt(d, "y", "id", "year", "g"), estimators.cohort_sizes(d, "id", "g"), -2, 2).collect()}
    bj = {r["k"]: r["att"] for r in estimators.bjs_att(estimators.bjs_effects(d, "y", "id", "year", "d"), "d").collect() if r["treated"]}
    for k, v in want.items():
        assert abs(sa[k] - v) < 0.05 and abs(cs[k] - v) < 0.05 and abs(bj[k] - v) < 0.05
    assert abs(sa[-2]) < 0.05 and abs(cs[-2]) < 0.05
    band = {r["k"]: r for r in resample.refit_band(d, "y", "id", "year", "d", draws=40).collect()}
    assert band[1]["lo"] - 0.05 <= want[1] <= band[1]["hi"] + 0.05
    wild = {r["k"]: r for r in resample.wild_band(estimators.bjs_effects(d, "y", "id", "year", "d"), "id", "d", draws=40).collect()}
    assert wild[0]["lo"] <= wild[0]["att"] <= wild[0]["hi"]


def test_imputation_with_controls_and_event_study(spark):
    d = frame(spark, simulated(120))
    att = {r["k"]: r["att"] for r in estimators.bjs_att(estimators.bjs_effects(d, "y", "id", "year", "d", ["x"]), "d").collect() if r["treated"]}
    assert all(abs(v - 1) < 0.05 for v in att.values())
    es = {r["k"]: r for r in estimators.event_study(d.where("k is null or k between -2 and 2").withColumn("t", (F.col("g") > 0).cast("int")), "y", "id", "year", "k", "t", -2, 2, controls=["x"]).collect()}
    assert abs(es[1]["coef"] - 1) < 0.05 and es[-1]["status"] == "reference"


def test_synthetic_control_of_a_convex_mix(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows, donors = [], r.normal(size=(6, 12)).cumsum(axis=1)
    for i in range(6):
        rows += [(100 + i, t, float(donors[i, t]), 0.0, 0, 0, None, "b") for t in range(12)]
    mix = 0.6 * donors[0] + 0.4 * donors[2]
    rows += [(1, t, float(mix[t] + (2 if t >= 7 else 0)), 0.0, 7, int(t >= 7), t - 7, "b") for t in range(12)]
    gaps = estimators.synthetic_control(spark.createDataFrame(rows, SCHEMA), "y", "id", "year", "g", "block")
    by = {x["k"]: x["gap"] for x in gaps.collect()}
    assert all(abs(by[k]) < 0.15 for k in range(-5, 0)) and all(abs(by[k] - 2) < 0.2 for k in range(0, 5))
    # all donors, gaps in some, one that does not vary, years left out: against the primal solved whole
    rows = [(i, t, float(r.normal() + t * 0.1), 0.0, 0, 0, None, "b") for i in range(200, 260) for t in range(14) if not (i == 210 and t == 5)]
    rows += [(300, t, 1.0, 0.0, 0, 0, None, "b") for t in range(14)] + [(u, t, float(r.normal() + t * 0.1), 0.0, 11, 0, None, "c") for u in (7, 8) for t in range(14) if not (u == 8 and t in (2, 3))]
    import pandas as pd

    p = pd.DataFrame(rows, columns=["id", "year", "y", "x", "g", "d", "k", "block"])
    monkeypatch.setattr(estimators, "DONORS", 16)
    monkeypatch.setattr(estimators, "UNITS", 1)
    got = {(x["id"], x["k"]): (x["gap"], x["n_donors"]) for x in estimators.synthetic_control(spark.createDataFrame(rows, SCHEMA), "y", "id", "year", "g", min_post=2).collect()}
    wide = p.pivot(index="year", columns="id", values="y")
    for u in (7, 8):
        own = wide[u].dropna()
        pool = wide.loc[own.index, [c for c in wide if c >= 200]].dropna(axis=1)
        pool = pool.loc[:, pool.loc[pool.index < 11].std() > 0]
        fit = [t for t in own.index if 1 <= t < 11]
        dist = 11.0 - np.array(fit)
        w = np.sqrt((1 - dist / dist.max()) ** 2 + 1e-6)
        a, b = pool.loc[fit].to_numpy() * w[:, None], own.loc[fit].to_numpy() * w
        weights = estimators.nonnegative(a.T @ a + 1e-3 * np.eye(a.shape[1]), a.T @ b, 20000, 1e-13)
        gap = own - pool @ weights
        gap -= gap.loc[fit].mean()
        for t in own.index:
            if -5 <= t - 11 <= 5:
                assert abs(got[u, t - 11][0] - gap.loc[t]) < 1e-4 and got[u, t - 11][1] == pool.shape[1]
    w = estimators.nonnegative(np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([1.0, -1.0]))
    assert (w >= 0).all() and abs(w[0] - 0.5) < 1e-8 and w[1] == 0
    assert resample.scm_band(gaps, "id", 20).count() == 11


def test_synthetic_control_of_copies(spark, monkeypatch):
    """Donors and units with equal values are one row each in every pass, and all units get their gaps."""
    r = np.random.default_rng(2)
    paths = {i: r.normal(size=8).cumsum() for i in range(12)}
    donors = [(100 * i + j, t, float(paths[i][t]), 0.0, 0, 0, None, "b") for i in range(1, 11) for j in range(3) for t in range(8)]
    units = [(j, t, float(paths[u][t]), 0.0, 6, 0, None, "b") for u in (0, 11) for j in range(5 * (u > 0), 5 + 5 * (u > 0)) for t in range(8)]
    staged, stage = {}, estimators.stage
    monkeypatch.setattr(estimators, "stage", lambda df, name="stage": staged.setdefault(name, stage(df, name)) if name not in staged else stage(df, name))
    got = estimators.synthetic_control(spark.createDataFrame(donors + units, SCHEMA), "y", "id", "year", "g", min_post=2, rounds=2).toPandas()
    assert staged["dual"].count() == 2
    assert sum(len(x["rows"]) for x in staged["donors"].collect()) == 10 * 9 * 8
    assert sorted(got["id"].unique()) == list(range(10)) and set(got["n_donors"]) == {30}
    assert (got.assign(kind=got["id"] >= 5).groupby(["kind", "k"])["gap"].nunique() == 1).all()



def test_matching_rules(spark):
    d = frame(spark, simulated(150))
    pairs = matching.match_cohorts(d, "id", "year", "g", "block", "x", "y").toPandas()
    per = pairs.groupby("cohort").control.agg(set)
    assert len(per) == 2 and not per.iloc[0] & per.iloc[1]
    cand = spark.createDataFrame([(t, c, "e", abs(t - c) / 10) for t in range(6) for c in range(4)], "tid long, cid long, e string, dist double")
    got = matching.match_greedy(cand, ["e"], 2, 2).toPandas()
    assert got.groupby("cid").size().max() <= 2 and got.groupby("tid").size().max() <= 2 and len(got) == 8
    assert matching.match_greedy(cand, ["e"], 2, None).count() == 12
    s = matching.propensity(d.where("year = 2").withColumn("t", (F.col("g") == 3).cast("int")), "t", ["x"])
    assert s.where("pscore between 0 and 1").count() == s.count()
    one = matching.propensity(d.where("g = 0").withColumn("t", F.lit(0)), "t", ["x"])
    assert one.where("pscore is not null").count() == 0
    stack = matching.stack_cohorts(d, spark.createDataFrame(pairs[["cohort", "id", "control", "distance"]]), "id", "year", "g", -2, 2).toPandas()
    assert not stack.duplicated(["id", "year"]).any() and stack.event_time.between(-2, 2).all()


def test_exploration_as_history_walk(spark):
    r = random.Random(1)
    rows = [(d, 2000 + d // 12, c, r.choice([1, 2, 3, None])) for d in range(120) for c in r.sample("abcdef", r.randint(1, 3))]
    got = {x["doc"]: x["exploration"] for x in docs.exploration(spark.createDataFrame(rows, "doc long, year long, cls string, actor long"), "doc", "year", "cls", "actor", 2).collect()}
    for d in range(120):
        cls = {c for x, _, c, _ in rows if x == d}
        year = 2000 + d // 12
        actors = {(c, a) for x, _, c, a in rows if x == d and a is not None}
        known = {c for c, a in actors if any(x < d and y >= year - 2 and c2 == c and a2 == a for x, y, c2, a2 in rows)}
        assert abs(got[d] - (1 - len(known) / len(cls))) < 1e-9


def test_nearest_event_ties_and_window(spark):
    p = spark.createDataFrame([(1, t) for t in range(0, 12)] + [(2, 5)], "id long, year long")
    e = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 6, "c"), (1, 6, "d"), (None, 5, "z")], "id long, at long, tag string")
    got = {(r["id"], r["year"]): (r["years_from_event"], r["tag"]) for r in joins.nearest_event(p, e, "id", "year", "at", ["tag"], 3).collect()}
    assert got[1, 4] == (2, "b") and got[1, 2] == (0, "b") and got[1, 5] == (-1, "c") and got[1, 9] == (3, "d") and got[1, 10] == (None, None) and got[2, 5] == (None, None) and got[1, 0] == (-2, "a")


def test_windows_and_grids(spark):
    d = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 4, 3.0), (2, 1, 5.0)], "id long, year long, v double")
    lag = {(r["id"], r["year"]): r["v_lag"] for r in windows.row_lag(d, "id", "year", ["v"], gap_aware=True).collect()}
    assert lag[1, 4] is None and lag[1, 2] == 1.0
    assert windows.forward_fill(d, "id", "year", "v").where("id = 1 and year = 2").first()["v"] == 1.0
    assert {(r["id"], r["year"]) for r in windows.grid(d, "id", F.min("year"), F.max("year"), "year").collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)}
    q = spark.createDataFrame([("g", v) for v in (1, 2, 2, 3)], "g string, v long")
    assert [r[0] for r in q.orderBy("v").select(windows.average_rank_percent("v", "g")).collect()] == [0.25, 0.625, 0.625, 1.0]
    a, b = windows.unit_sample(d, "id", 1, 7).collect(), windows.unit_sample(d, "id", 1, 7).collect()
    assert a == b and len({r["id"] for r in a}) == 1


def test_null_rules_and_scalars(spark):
    d = spark.createDataFrame([("g", None, "x1"), ("g", None, "12"), ("h", float("nan"), "7")], "g string, v double, i string")
    assert {r["g"]: r["s"] for r in d.withColumn("v", nulls.nan_to_null("v")).groupBy("g").agg(nulls.sum0("v").alias("s")).collect()} == {"g": 0.0, "h": 0.0}
    assert sorted(r["i"] for r in nulls.coerce_ids(d, "i").collect()) == [7, 12]
    with pytest.raises(Exception, match="not unique"):
        nulls.assert_unique(d, "g").collect()
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.percent(F.lit("about 12.5%"))) == 12.5 and one(scalars.percent(F.lit("1,250"))) == 100.0 and one(scalars.percent(F.lit("n/a"))) is None
    assert one(scalars.industry_code(F.lit("0100.0"))) == "0100" and one(scalars.industry_code(F.lit("357"))) == "0357" and one(scalars.industry_code(F.lit("3571"), 2)) == "35"
    assert one(scalars.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None and one(scalars.ratio(F.lit(1), F.lit(0))) is None
    assert one(scalars.sum_any(F.lit(None).cast("double"), F.lit(2.0))) == 2.0 and one(scalars.sum_any(F.lit(None).cast("double"))) is None
    assert one(scalars.parse_date(F.lit("20240230"))) is None and one(scalars.stars(F.lit(0.03))) == "**"


def test_pair_novelty_and_moves(spark):
    rows = [(1, "2000-01-01", "a"), (1, "2000-01-01", "b"), (2, "2000-01-01", "b"), (2, "2000-01-01", "a"), (3, "2001-01-01", "a"), (3, "2001-01-01", "b"), (3, "2001-01-01", "c"), (4, "2001-01-01", "a")]
    got = {r["d"]: (r["new_pairs"], r["total_pairs"], r["novelty"]) for r in docs.pair_novelty(spark.createDataFrame(rows, "d long, t string, c string"), "d", "t", "c").collect()}
    assert got[1] == got[2] == (1, 1, 1.0) and got[3][:2] == (2, 3) and got[4] == (0, 0, 0.0)
    seq = spark.createDataFrame([(1, i, s) for i, s in enumerate("aaabbbaaabbb")] + [(2, i, s) for i, s in enumerate("aabb")], "u long, t long, s string")
    assert [(r["u"], r["t"], r["from_state"], r["to_state"]) for r in moves.stable_moves(seq, "u", "s", ["t"]).orderBy("t").collect()] == [(1, 3, "a", "b"), (1, 6, "b", "a")]


def test_splits_placebos_and_balance(spark):
    d = frame(spark, simulated(100))
    t = d.withColumn("t", (F.col("g") > 0).cast("int"))
    bins = hetero.quantile_z(t, "x", "t", 4, "q").where("t = 1").groupBy("q").count().toPandas()
    assert set(bins.q) == {0, 1, 2, 3} and bins["count"].max() - bins["count"].min() <= 2
    p = resample.placebo(d, "id", "year", "g", "permute", seed=3)
    before = sorted(r[0] for r in d.where("g > 0").select("id", "g").distinct().select("g").collect())
    assert sorted(r[0] for r in p.where("g_placebo > 0").select("id", "g_placebo").distinct().select("g_placebo").collect()) == before
    assert p.where("g > 0 and year >= g").count() == 0
    ev = d.where("g > 0").select("id", "g").distinct()
    b = panels.balanced_event_panel(d.drop("g", "k"), ev, "id", "year", "g", -2, 2, ["y"], [])
    assert diagnostics.window_balance(b, ["id", "g"], "k", -2, 2).first()["n_unbalanced"] == 0
    assert abs(diagnostics.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-4
    w = diagnostics.welch(t, "t", ["x"]).first()
    assert 0 <= w["p"] <= 1 and diagnostics.collinearity(t.withColumn("x2", F.col("x")), ["x", "x2"], "id", "year").first()["equal_pairs"] == 1


def test_plans_stay_native(spark):
    from panelkit.plans import catalog

    for name in ("exploration_person", "nearest_event", "pair_novelty_class", "interval_link", "entity_year_panel"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan and "Arrow" not in plan, name


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(o) > 60


def test_exact_quantiles_of_ties_nulls_and_narrow_brackets(spark, monkeypatch):
    from panelkit.operators import quantiles

    monkeypatch.setattr(quantiles, "INSIDE", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    r = np.random.default_rng(3)
    v = np.r_[r.normal(size=3000), np.zeros(2000), r.integers(0, 4, 1000)]
    rows = [(float(x), i % 2) for i, x in enumerate(v)] + [(None, 0), (float("nan"), 1)]
    d = spark.createDataFrame(rows, "v double, t int").repartition(5)
    ps = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.99, 1.0]
    got = quantiles.exact_quantiles(d, [("a", "v", ps), ("b", "CASE WHEN t = 1 THEN v END", ps), ("none", "CASE WHEN t = 7 THEN v END", [0.5])])
    assert np.allclose(got["a"], np.quantile(v, ps), atol=1e-12) and np.allclose(got["b"], np.quantile(v[1::2], ps), atol=1e-12) and got["none"] == [None]
    for inside, accuracy in ((2_000, 10_000), (300, 2_000)):  # no passes between, and some
        monkeypatch.setattr(quantiles, "INSIDE", inside)
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        got, n = quantiles.counted_quantiles(d, [("a", "v", ps), ("none", "CASE WHEN t = 7 THEN v END", [0.5])])
        assert np.allclose(got["a"], np.quantile(v, ps), atol=1e-12) and n == {"a": len(v), "none": 0}


@pytest.mark.parametrize(("inside", "steps"), [(2_000, 256), (20, 16)])
def test_quantiles_by_group_with_one_very_large_group(spark, monkeypatch, inside, steps):
    from panelkit.operators import quantiles

    monkeypatch.setattr(quantiles, "INSIDE", inside)
    monkeypatch.setattr(quantiles, "STEPS", steps)
    r = np.random.default_rng(4)
    rows = [("big", float(x)) for x in r.normal(size=3000)] + [("ties", float(x)) for x in r.integers(0, 3, 500)] + [("one", 7.0)] * 90 + [(None, float(x)) for x in range(31)] + [("none", None), ("nan", float("nan"))] + [(f"g{i % 40}", float(i)) for i in range(300)]
    got = {x["g"]: x["q"] for x in quantiles.quantiles_by(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0, 0.01, 0.5, 0.9, 0.99, 1]).collect()}
    p = pd.DataFrame(rows, columns=["g", "v"]).dropna(subset=["v"])
    want = {k if isinstance(k, str) else None: d.v.quantile([0, 0.01, 0.5, 0.9, 0.99, 1]).tolist() for k, d in p.groupby("g", dropna=False)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=1e-12) for k in want)


def test_permuted_years_move_and_stay_the_same_set(spark, monkeypatch):
    monkeypatch.setattr(windows, "RANK_CELL", 50)
    d = spark.createDataFrame([(i, 2000 + i % 7) for i in range(700)] + [(1000 + i, 0) for i in range(50)], "id long, g long").withColumn("year", F.lit(1990).cast("long"))
    p = resample.placebo(d, "id", "year", "g", "permute").where("g > 0").toPandas()
    assert len(p) == 700 and sorted(p.g_placebo) == sorted(p.g) and (p.g == p.g_placebo).mean() < 0.25
    assert resample.placebo(d, "id", "year", "g", "permute", seed=9).where("g > 0").toPandas().merge(p, on="id").eval("g_placebo_x != g_placebo_y").mean() > 0.5
    ranks = windows.global_rank(d.select("id"), "id", "r", 5).toPandas().sort_values("r")
    assert ranks.r.tolist() == list(range(1, 751))


def test_lag_of_equal_periods_is_the_same_in_every_run(spark):
    rows = [(1, 1, 5.0), (1, 1, 3.0), (1, 2, 9.0), (1, 2, None)]
    for order in (rows, rows[::-1]):
        got = windows.row_lag(spark.createDataFrame(order, "id long, t long, v double"), "id", "t", ["v"]).collect()
        assert {(r["t"], r["v"]): r["v_lag"] for r in got} == {(1, 3.0): None, (1, 5.0): 3.0, (2, None): 5.0, (2, 9.0): None}


def test_draws_are_multinomial(spark, monkeypatch):
    monkeypatch.setattr(resample, "DRAW_CELL", 30)
    w = resample.drawn_units(spark.range(200).withColumnRenamed("id", "u"), 40, 3).toPandas()
    assert (w.groupby("b").w.sum() == 200).all() and w.b.nunique() == 40  # each draw picks as many as there are
    counts = w.groupby("u").w.sum().reindex(range(200), fill_value=0)
    assert abs(counts.mean() - 40) < 1e-9 and 20 < counts.var() < 70
    assert resample.drawn_units(spark.range(200).withColumnRenamed("id", "u"), 40, 3).toPandas().sort_values(["b", "u"]).reset_index(drop=True).equals(w.sort_values(["b", "u"]).reset_index(drop=True))


def test_doubly_robust_cells_as_a_plain_fit(spark):
    d = frame(spark, simulated(240, seed=4, effect=lambda g, k: 1.0 + 0.2 * k))
    got = {(r["g"], r["t"]): r for r in estimators.att_gt_dr(d, "y", "id", "year", "g", ["x"]).collect()}
    p = d.toPandas()
    for (g, t), r in got.items():
        b = g - 1 if t >= g else t - 1
        part = p[(p.g == g) | (p.g == 0) | (p.g > max(t, b))]
        z = part[part.year == b][["id", "g", "y", "x"]].merge(part[part.year == t][["id", "y"]], on="id", suffixes=("", "1"))
        q, w, dy = np.column_stack([np.ones(len(z)), z.x]), (z.g == g).to_numpy(float), (z.y1 - z.y).to_numpy()
        beta = np.linalg.lstsq(q[w == 0], dy[w == 0], rcond=None)[0]
        th = np.zeros(2)
        for _ in range(60):
            ps = 1 / (1 + np.exp(-q @ th))
            th += np.linalg.solve((q * (ps * (1 - ps))[:, None]).T @ q, q.T @ (w - ps))
        ps = np.minimum(1 / (1 + np.exp(-q @ th)), 0.995)
        res, odds = dy - q @ beta, (1 - w) * ps / (1 - ps)
        assert abs(r["att"] - ((w * res).sum() / w.sum() - (odds * res).sum() / odds.sum())) < 1e-7 and r["method"] == "doubly robust"
        assert (r["n_treated"], r["n_control"]) == (int(w.sum()), int((1 - w).sum()))
    assert len(got) > 8
    flat = estimators.att_gt_dr(d.withColumn("x", F.lit(1.0)), "y", "id", "year", "g", ["x"]).collect()
    plain = {(r["g"], r["t"]): r["att"] for r in estimators.att_gt(d, "y", "id", "year", "g").collect()}
    assert all(r["method"] == "difference of means" and abs(r["att"] - plain[r["g"], r["t"]]) < 1e-6 for r in flat)


def test_greedy_matching_as_a_walk(spark):
    r = random.Random(2)
    units = [("t", i, r.choice("ab"), r.random()) for i in range(60)] + [("c", 100 + i, r.choice("ab"), round(r.random(), 1)) for i in range(25)]
    side = lambda k: spark.createDataFrame([(i, e, s) for kind, i, e, s in units if kind == k], "id long, e string, score double")
    cand = matching.candidates(side("t"), side("c"), ["e"], "score", 0.15, [])
    want = [(t, c, e, abs(s - z)) for k, t, e, s in units if k == "t" for k2, c, e2, z in units if k2 == "c" and e == e2 and abs(s - z) <= 0.15]
    assert sorted((x["tid"], x["cid"], x["e"], x["dist"]) for x in cand.collect()) == sorted(want)
    for n, reuse in ((3, 2), (1, 1), (2, 5)):
        used, walk = {}, []
        for t in range(60):
            k = 0
            for d, c in sorted((d, c) for x, c, _, d in want if x == t):
                if k < n and used.get(c, 0) < reuse:
                    k += 1
                    used[c] = used.get(c, 0) + 1
                    walk.append((t, c, k))
        got = matching.match_greedy(cand, ["e"], n, reuse)
        assert sorted((x["tid"], x["cid"], x["control_rank"]) for x in got.collect()) == sorted(walk)


def test_unit_effects_and_ranking_of_covariates(spark):
    r = np.random.default_rng(5)
    n = 3000
    x, z, w = r.normal(size=n), r.normal(size=n), r.integers(0, 2, n)
    y = x + z + w * (1.0 + 2.0 * x) + r.normal(size=n) * 0.1
    d = spark.createDataFrame([(i, float(a), float(b), int(c), float(e)) for i, (a, b, c, e) in enumerate(zip(x, z, w, y, strict=True))], "id long, x double, z double, w int, y double")
    ate, unit, ranking = estimators.dml_cate(d, "y", "w", ["z", "x"], "id", trees=20)
    a = ate.first()
    assert a["lo"] < 1.0 + 2 * x.mean() < a["hi"] and a["n"] == n
    u = unit.toPandas().sort_values("id")
    assert np.corrcoef(u.cate, 1 + 2 * x)[0, 1] > 0.95
    assert [(v["name"], v["place"]) for v in ranking.orderBy("place").collect()] == [("x", 1), ("z", 2)]


def test_small_helpers(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "id long, t long, v string")
    got = windows.shifts(d, "id", ["t"], "v", [1, -1]).orderBy("t").collect()
    assert [(r["v_prev1"], r["v_next1"]) for r in got] == [(None, "b"), ("a", "c"), ("b", None)]
    assert nulls.keep_columns(d, ["v", "none", "id"]).columns == ["v", "id"] and nulls.first_existing(d, "x", "t", "v") == "t" and nulls.first_existing(d, "x") is None
    assert [tuple(r) for r in d.select(*[c.alias(n) for n, c in scalars.dummies("v", ["a", "b", "c"]).items()]).collect()] == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    fit = fe_ols(frame(spark, simulated()).withColumns({"treat_x_z": F.col("d") * F.col("x")}), "y", ["d", "treat_x_z"], "id", "year")
    fit.names = ["treat", "treat_x_z"]
    effect, se = estimators.group_effect(fit)
    assert abs(effect - fit.beta.sum()) < 1e-12 and abs(se**2 - fit.cov.sum()) < 1e-12


def test_base_tables_are_read_once(spark):
    from panelkit.plans import catalog

    for name, most in (("peer_benchmark", 12), ("event_proximity", 8), ("rolling_similarity", 8), ("pairwise_similarity", 6), ("relative_talent", 24)):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= most and "lineitem.parquet" not in plan, (name, plan.count("FileScan parquet"))


def test_cells_are_regressors_of_their_own(spark):
    p = simulated(drop=0.1)
    d = frame(spark, p).withColumn("cell", F.when(F.col("k").between(0, 2), F.col("k").cast("int")))
    fit = fe_ols(d, "y", ["x"], "id", "year", cells=("cell", ["k0", "k1", "k2"]))
    for k in range(3):
        p[f"k{k}"] = (p.k == k).astype(float)
    b, se = dense(p, ["x", "k0", "k1", "k2"], "entity")
    assert fit.names == ["x", "k0", "k1", "k2"] and np.allclose(fit.beta, b, atol=1e-8) and np.allclose(fit.se(), se, atol=1e-8)


def test_greedy_matching_of_copies(spark, monkeypatch):
    """Units that all want the same controls in the same order: a few steps, not one for every two units; also across batches."""
    rows = [(t, 1000 + c, "a", abs(c % 2 - 0.5)) for t in range(40) for c in range(70)]
    want, used = [], {}
    for t in range(40):
        free = [c for c in range(70) if used.get(c, 0) < 2][:3]
        for i, c in enumerate(free):
            used[c] = used.get(c, 0) + 1
            want.append((t, 1000 + c, i + 1))
    steps, stage = [], matching.stage
    monkeypatch.setattr(matching, "stage", lambda df, name="stage": steps.append(name) or stage(df, name))
    pairs = spark.createDataFrame(rows, "tid long, cid long, e string, dist double")
    for size, most in ((256, 4), (16, 6)):
        monkeypatch.setattr(matching, "WALK", size)
        steps.clear()
        assert sorted((r["tid"], r["cid"], r["control_rank"]) for r in matching.match_greedy(pairs, ["e"], 3, 2).collect()) == want
        assert len(steps) <= most


def test_quantiles_read_the_table_once(spark):
    from panelkit.operators import quantiles

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.range(6000).select((F.col("id") * 1.0).alias("v")).mapInArrow(counted, "v double")
    assert quantiles.exact_quantiles(d, [("a", "v", [0.5]), ("b", "v", [0.0, 1.0])]) == {"a": [2999.5], "b": [0.0, 5999.0]}
    assert seen.value == 6000
