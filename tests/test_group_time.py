import numpy as np
import pandas as pd
import pytest
from panelkit.operators import group_time as G
from pyspark.sql import functions as F

SCHEMA = "id long, year long, y double, x double, s double, g long, ga long, gb long"


def panel(seed=0, n=240, years=9):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        ga, gb = int(r.choice([0, 0, 3, 5, 7])), int(r.choice([0, 0, 4, 5]))
        g = min((c for c in (ga, gb) if c), default=0)
        a, s = r.normal(), float(r.random() < 0.4)
        for t in range(1, years + 1):
            x = r.normal()
            y = a + 0.2 * t * (1 + s) + 0.4 * x + (1.0 + s if ga and t >= ga else 0) - (0.5 if gb and t >= gb else 0) + 0.01 * r.normal()
            rows.append((i, t, y, x, s, g or None, ga or None, gb or None))
    return rows


def walk_sample(rows, role, strict, min_cohort, before, after):
    """The sample's (id, year) by plain loops."""
    k = {"a": 6, "b": 7}[role]
    d = [(r[0], r[1], r[2], r[k] or 0, r[5]) for r in rows]
    if strict:
        ok = {i for i, _, _, g, every in d if every is None or g == every}
        d = [r for r in d if r[0] in ok]
    d = [r for r in d if r[2] is not None]
    size = {g: len({r[0] for r in d if r[3] == g}) for g in {r[3] for r in d}}
    d = [r for r in d if r[3] == 0 or size[r[3]] >= min_cohort]
    gs = [r[3] for r in d if r[3]]
    d = [r for r in d if min(gs) - before <= r[1] <= max(gs) + after and (r[3] == 0 or -before <= r[1] - r[3] <= after)]
    free = {r[1] for r in d if r[3] == 0 or r[3] > r[1]}
    return {(r[0], r[1]) for r in d if r[1] in free}


@pytest.mark.parametrize("strict", [True, False])
def test_sample_as_plain_loops(spark, strict):
    rows = panel(1)
    rows = [r if (r[0] + r[1]) % 17 else (r[0], r[1], None, *r[3:]) for r in rows]
    d = spark.createDataFrame(rows, SCHEMA)
    got = G.role_sample(d, "y", "id", "year", {"a": "ga", "b": "gb"}, "g", [], strict, 20, 2, 3).collect()
    for role in "ab":
        assert {(r["e"], r["t"]) for r in got if r["role"] == role} == walk_sample(rows, role, strict, 20, 2, 3)


def test_small_cohorts_and_periods_without_controls_go():
    counts = [("r", 0, t, 5) for t in (2, 3, 4)] + [("r", 4, t, 9) for t in range(1, 8)] + [("r", 6, t, 3) for t in range(1, 8)] + [("s", 2, t, 9) for t in (1, 2, 3)]
    keep = G.identified(counts, {("r", 4): 9, ("r", 6): 3, ("s", 2): 9}, 4, 2, 3)
    assert {x for x in keep if x[0] == "r"} == {("r", 0, 2), ("r", 0, 3), ("r", 0, 4), ("r", 4, 2), ("r", 4, 3), ("r", 4, 4)}
    assert [x for x in keep if x[0] == "s"] == [("s", 2, 1)]  # nobody is a control from year 2 on
    assert ("r", 4, 4) not in G.identified(counts, {("r", 4): 9}, 4, 2, 3, min_treated=10)
    assert G.identified(counts, {("r", 4): 2}, 4, 2, 3) == []


def cell(sample, role, g, t):
    b = g - 1 if t >= g else t - 1
    p = sample[sample.role == role]
    p = p[(p.g == g) | (p.g == 0) | (p.g > max(t, b))]
    return p[p.t == b].merge(p[p.t == t][["e", "y"]], on="e", suffixes=("", "1"))


def logistic(q, w):
    th = np.zeros(q.shape[1])
    for _ in range(60):
        ps = 1 / (1 + np.exp(-q @ th))
        th += np.linalg.solve((q * (ps * (1 - ps))[:, None]).T @ q, q.T @ (w - ps))
    return np.minimum(1 / (1 + np.exp(-q @ th)), 0.995)


def test_cells_of_two_roles_as_plain_fits(spark):
    d = spark.createDataFrame(panel(3), SCHEMA)
    sample = G.role_sample(d, "y", "id", "year", {"a": "ga", "b": "gb"}, "g", ["x", "s"], True, 20, 2, 3)
    got, p = G.att_gt_by_role(sample, ["x", "s"]).collect(), sample.toPandas()
    assert {r["role"] for r in got} == {"a", "b"} and len(got) > 15
    for r in got:
        z = cell(p, r["role"], r["g"], r["t"])
        q, w, dy = np.column_stack([np.ones(len(z)), z.x0, z.x1]), (z.g == r["g"]).to_numpy(float), (z.y1 - z.y).to_numpy()
        assert (r["n_treated"], r["n_control"]) == (int(w.sum()), int((1 - w).sum()))
        assert r["method"] == "doubly robust"
        beta, ps = np.linalg.lstsq(q[w == 0], dy[w == 0], rcond=None)[0], logistic(q, w)
        res, odds = dy - q @ beta, (1 - w) * ps / (1 - ps)
        assert abs(r["att"] - ((w * res).sum() / w.sum() - (odds * res).sum() / odds.sum())) < 1e-6
    post = [r["att"] for r in got if r["role"] == "a" and r["t"] >= r["g"]]
    overall = {r["role"]: r["att"] for r in G.att_overall(spark.createDataFrame(got)).collect()}
    assert overall["a"] == pytest.approx(np.mean(post))


def test_weights_take_over_where_the_regression_is_singular(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(120):
        w = i % 3 == 0
        x = 0.5 if not w else float(r.normal(0.5, 1))  # controls do not vary: no regression, yet a propensity
        z = float(r.normal())
        rows.append(("c", float(w), float(r.normal() + w), x, z))
        rows.append(("sep", float(w), float(r.normal() + w), float(w), z))  # treated by x alone: no propensity
    d = spark.createDataFrame(rows, "cell string, w double, dy double, x0 double, x1 double")
    got = G.fit_cells(d, 2)
    p = pd.DataFrame(rows, columns=["cell", "w", "dy", "x", "z"])
    c = p[p.cell == "c"]
    q, w, dy = np.column_stack([np.ones(len(c)), c.x, c.z]), c.w.to_numpy(), c.dy.to_numpy()
    odds = (1 - w) * (lambda ps: ps / (1 - ps))(logistic(q, w))
    assert got["c"][3] == "inverse probability" and got["c"][0] == pytest.approx((w * dy).sum() / w.sum() - (odds * dy).sum() / odds.sum(), abs=1e-6)
    s = p[p.cell == "sep"]
    assert got["sep"][3] == "difference of means" and got["sep"][0] == pytest.approx(s[s.w == 1].dy.mean() - s[s.w == 0].dy.mean())


def test_nulls_repeats_and_empty_tables(spark):
    rows = panel(2, n=90)
    d = spark.createDataFrame(rows, SCHEMA)
    roles = {"a": "ga", "b": "gb"}
    again = d.unionByName(d.where("id < 20")).unionByName(spark.createDataFrame([(None, 3, 1.0, 1.0, 0.0, 3, 3, 3), (5, None, 1.0, 1.0, 0.0, 3, 3, 3), (5000, 2, float("inf"), 1.0, 0.0, None, None, None)], SCHEMA))
    take = lambda x: sorted((r["role"], r["e"], r["t"], r["g"]) for r in G.role_sample(x, "y", "id", "year", roles, "g", ["x"], True, 5).collect())
    assert take(again) == take(d)
    none = G.role_sample(d.limit(0), "y", "id", "year", roles, "g", ["x"])
    assert none.collect() == [] and G.att_gt_by_role(none, ["x"]).collect() == []
    assert G.att_gt_by_role(G.role_sample(d.withColumns({"ga": F.lit(None).cast("long"), "gb": F.lit(0)}), "y", "id", "year", roles, "g")).collect() == []


def test_equal_units_of_a_cell_are_one_row(spark, monkeypatch):
    d = spark.createDataFrame(panel(3), SCHEMA)
    staged, stage = {}, G.stage
    monkeypatch.setattr(G, "stage", lambda df, name="stage": staged.setdefault(name, stage(df, name)))
    sample = G.role_sample(d, "y", "id", "year", {"a": "ga", "b": "gb"}, "g", ["s"], True, 20, 2, 3)
    got, p, z = G.att_gt_by_role(sample, ["s"]).collect(), sample.toPandas(), staged["changes"]
    assert z.count() == z.select("cell", "w", "x0").distinct().count() <= 4 * z.select("cell").distinct().count()
    for r in got:
        c = cell(p, r["role"], r["g"], r["t"])
        w, s, dy = (c.g == r["g"]).to_numpy(), c.x0.to_numpy(), (c.y1 - c.y).to_numpy()
        assert (r["n_treated"], r["n_control"], r["method"]) == (w.sum(), (~w).sum(), "doubly robust")
        assert r["att"] == pytest.approx(sum((w & (s == v)).sum() * (dy[w & (s == v)].mean() - dy[~w & (s == v)].mean()) for v in (0, 1)) / w.sum(), abs=1e-6)
