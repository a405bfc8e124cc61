import numpy as np
import pytest
from panelkit.operators import estimators, placebos, resample
from panelkit.operators.gram import Fit, fe_many, fe_ols
from pyspark.sql import functions as F
from test_core import dense, frame, simulated


def wide(spark, seed=6, drop=0.15):
    p = simulated(80, seed=seed, drop=drop)
    p["u"] = (p["id"] % 4 != 1).astype(int)
    p["z"] = np.where(p["id"] % 7 == 0, np.nan, p["x"] ** 2)
    d = frame(spark, p).withColumns({"u": F.when(F.col("id") % 4 != 1, 1).otherwise(0), "z": F.when(F.col("id") % 7 != 0, F.col("x") * F.col("x")), "bad": F.when(F.col("id") == 3, float("inf")).otherwise(F.col("x"))})
    return p, d


def test_many_fits_as_each_alone(spark):
    p, d = wide(spark)
    fits = [Fit("all", "y", ["d", "x"]), Fit("some", "y", ["d"], "u", cov="twoway"), Fit("holes", "x", ["d", "z"], cov="robust"), Fit("inf", "y", ["bad"], cov="time"), Fit("none", "y", ["d"], "never")]
    got = fe_many(d.withColumn("never", F.lit(0)), fits, "id", "year")
    for key, rows, cols, y, cov in (("all", p, ["d", "x"], "y", "entity"), ("some", p[p.u == 1], ["d"], "y", "twoway"), ("holes", p[p.z.notna()], ["d", "z"], "x", "robust")):
        q = rows.assign(y=rows[y]) if y != "y" else rows
        b, se = dense(q, cols, cov)
        fit = got[key]
        assert np.allclose(fit.beta, b, atol=1e-8) and np.allclose(fit.se(), se, atol=1e-8) and fit.nobs == len(rows) and fit.n_entities == rows.id.nunique()
    assert got["inf"].nobs == len(p[p.id != 3]) and got["none"].status == "no rows"
    alone = fe_ols(d, "y", ["bad"], "id", "year", "time")
    assert np.allclose(alone.beta, got["inf"].beta) and np.allclose(alone.cov, got["inf"].cov) and alone.r2 == pytest.approx(got["inf"].r2)


def test_imputed_effects_as_by_rows(spark):
    p, d = wide(spark, 8)
    d = d.where("not (id % 5 = 2 and year < 3)")  # another first period for some
    got = fe_many(d, [Fit("i", "y", ["x"], impute=("d", "k", -3, 3)), Fit("first", "y", [], "u", impute=("d", "k", 0, 1))], "id", "year")
    want = {(r["d"], r["k"]): (r["s"], r["n"]) for r in estimators.bjs_effects(d, "y", "id", "year", "d", ["x"]).where("k between -3 and 3").groupBy("d", "k").agg(F.sum("tau").alias("s"), F.count("*").alias("n")).collect()}
    assert got["i"].effects.keys() == want.keys()
    assert all(got["i"].effects[c][1] == n and abs(got["i"].effects[c][0] - s) < 1e-7 for c, (s, n) in want.items())
    assert {k for _, k in got["first"].effects} <= {0, 1}


def test_all_fits_read_the_rows_once_a_pass(spark, monkeypatch):
    from panelkit.operators import gram

    plans = []
    by = gram.by_entity
    monkeypatch.setattr(gram, "by_entity", lambda d, times: plans.append(by(d, times)) or plans[-1])
    _, d = wide(spark)
    estimators.heterogeneity_specs(d.withColumns({"post": F.lit(1) * (F.col("year") > 4).cast("int"), "z2": F.col("x") + 1}), ["y", "x"], {"a": "z", "b": "z2"}, "id", "year", post="post", treat="d")
    assert len(plans) == 1
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert text.count("hashpartitioning") <= 1 and text.count("Scan ") == 1


def test_suite_as_single_estimators(spark):
    p = simulated(120, seed=9, effect=lambda g, k: 2.0)
    d = frame(spark, p).withColumns({"other": F.when(F.col("id") % 3 == 0, F.col("g") - F.col("g")).otherwise(F.col("g")), "noise": F.rand(3)})
    got = placebos.placebo_studies(d, ["y", "noise"], "id", "year", {"a": "g", "b": "other"}, "g", lead=2, lo=-3, hi=2, alpha=1e-6).collect()
    assert {(r["role"], r["outcome"]) for r in got} == {("a", "y"), ("b", "y")}  # the gate keeps noise out
    assert {r["method"] for r in got} == set(placebos.METHODS)
    for kind in placebos.KINDS:
        x = resample.placebo(d, "id", "year", "g", kind, 2)
        near = x.where(f"k_placebo is null or k_placebo between -3 and {1 if kind == 'lead' else 2}")
        mine = {(r["method"], r["k"]): r for r in got if r["role"] == "a" and r["kind"] == kind}
        did = fe_ols(x, "y", ["d_placebo"], "id", "year")
        assert mine["did", None]["coef"] == pytest.approx(did.beta[0]) and mine["did", None]["se"] == pytest.approx(did.se()[0]) and mine["did", None]["n"] == did.nobs
        sa = {r["k"]: r for r in estimators.sun_abraham(near, "y", "id", "year", "g_placebo", -3, 2).collect() if r["k"] != -1}
        assert {k for m, k in mine if m == "sun_abraham"} == set(sa)
        assert all(mine["sun_abraham", k]["coef"] == pytest.approx(r["coef"]) and mine["sun_abraham", k]["se"] == pytest.approx(r["se"]) for k, r in sa.items())
        es = {r["k"]: r for r in estimators.event_study(near.withColumn("w", (F.col("g_placebo") > 0).cast("int")), "y", "id", "year", "k_placebo", "w", -3, 2).collect() if r["k"] != -1 and r["coef"] is not None}
        assert {k for m, k in mine if m == "event_study"} == set(es) and all(mine["event_study", k]["se"] == pytest.approx(r["se"]) for k, r in es.items())
        bj = {r["k_placebo"]: r for r in estimators.bjs_att(estimators.bjs_effects(near, "y", "id", "year", "d_placebo", k="k_placebo"), "d_placebo", "k_placebo").collect() if r["treated"]}
        assert {k for m, k in mine if m == "imputation"} == {k for k in bj if k is not None}
        assert all(mine["imputation", k]["coef"] == pytest.approx(r["att"], abs=1e-8) for k, r in bj.items() if k is not None)


def test_suite_of_nothing(spark):
    d = frame(spark, simulated(20, seed=1)).withColumn("other", F.lit(None).cast("long"))
    assert placebos.placebo_studies(d.limit(0), ["y"], "id", "year", {"a": "g"}, "g").collect() == []
    got = placebos.placebo_studies(d.unionByName(d.limit(3)).withColumn("y", F.when(F.col("id") != 4, F.col("y"))), ["y"], "id", "year", {"a": "g", "b": "other"}, "g", 1, -2, 2, alpha=None).collect()
    assert {r["role"] for r in got} == {"a"} and all(r["coef"] == r["coef"] for r in got)
