import math
import random

import pytest
from panelkit.operators import matching, nearest
from pyspark.sql import functions as F

SCHEMA = "id long, block string, treated int, x1 double, x2 double, kind string"


def units(seed, n=900, far=8):
    """A dense spot, a heavy point with a third of all rows, a wide cloud, some units far away, ties, missing values."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        b = r.choice("aaab")
        if i % 3 == 0:
            x = (1.0, 1.0)
        elif i % 3 == 1:
            x = (round(r.gauss(5, 0.01), 4), round(r.gauss(5, 0.01), 4))
        else:
            x = (round(r.gauss(0, 3), 1), round(r.gauss(0, 30), 1))
        if i < far:
            x = (500.0 * (i + 1), -900.0)
        rows.append((i, b, int(r.random() < 0.3), *x, r.choice("pq")))
    return rows + [(10_000, "a", 1, None, 1.0, "p"), (10_001, "a", 0, 1.0, None, "q"), (10_002, None, 1, 1.0, 1.0, "p"), (10_003, "only", 1, 1.0, 1.0, "p")]


def brute_mahalanobis(rows, caliper=None):
    out = {}
    for b in "ab":
        p = [r for r in rows if r[1] == b and r[3] is not None and r[4] is not None]
        m1, m2, n = sum(r[3] for r in p) / len(p), sum(r[4] for r in p) / len(p), len(p) - 1
        va, vc, vb = sum((r[3] - m1) ** 2 for r in p) / n + 1e-8, sum((r[4] - m2) ** 2 for r in p) / n + 1e-8, sum((r[3] - m1) * (r[4] - m2) for r in p) / n
        for t in (r for r in p if r[2]):
            best = None
            for c in (r for r in p if not r[2]):
                if caliper is not None and abs(t[4] - c[4]) > caliper:
                    continue
                d1, d2 = t[3] - c[3], t[4] - c[4]
                d = math.sqrt(max((vc * d1 * d1 - 2 * vb * d1 * d2 + va * d2 * d2) / (va * vc - vb * vb), 0))
                if best is None or d < best[0] - 1e-12 or abs(d - best[0]) <= 1e-12 and c[0] < best[1]:
                    best = (d, c[0])
            if best:
                out[t[0]] = best
    return out


@pytest.mark.parametrize(("direct", "caliper"), [(0, None), (0, 20.0), (10**9, None)])
def test_mahalanobis_as_all_pairs(spark, monkeypatch, direct, caliper):
    monkeypatch.setattr(nearest, "DIRECT", direct)
    monkeypatch.setattr(nearest, "MOST", 16)
    rows = units(1)
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: (r["distance"], r["control"]) for r in matching.match_mahalanobis(d, "id", "treated", "block", "x1", "x2", caliper, "x2" if caliper else None).collect()}
    want = brute_mahalanobis(rows, caliper)
    assert got.keys() == want.keys()
    assert all(got[i][0] == pytest.approx(d, abs=1e-9) and got[i][1] == c for i, (d, c) in want.items())


@pytest.mark.parametrize("category", [None, "kind"])
def test_euclid_as_all_pairs(spark, monkeypatch, category):
    monkeypatch.setattr(nearest, "DIRECT", 0)
    monkeypatch.setattr(nearest, "MOST", 16)
    rows = units(2, 500)
    d = spark.createDataFrame(rows, SCHEMA)
    t, c = d.where("treated = 1"), d.where("treated = 0 or id % 10 = 0")  # some are on both sides
    got = {}
    for r in matching.match_euclid(t, c, ["block"], ["x1", "x2"], category, 3).collect():
        got.setdefault(r["tid"], []).append((r["control_rank"], r["cid"], r["dist"]))
    both = [r for r in rows if r[2] == 1] + [r for r in rows if r[2] == 0 or r[0] % 10 == 0]
    sd = []
    for k in (3, 4):
        v = [r[k] for r in both if r[k] is not None]
        sd.append(math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)))
    for a in (r for r in rows if r[2] == 1):
        near = []
        for b in (r for r in rows if r[2] == 0 or r[0] % 10 == 0):
            if a[1] is None or a[1] != b[1] or a[0] == b[0]:
                continue
            s = sum(((a[k] - b[k]) / sd[k - 3]) ** 2 for k in (3, 4) if a[k] is not None and b[k] is not None)
            near.append((round(math.sqrt(s + (2 if category and a[5] != b[5] else 0)), 9), b[0]))
        near = sorted(near)[:3]
        assert [round(x[2], 9) for x in sorted(got.get(a[0], []))] == [x[0] for x in near]
        assert {x[1] for x in got.get(a[0], [])} == {x[1] for x in near}


def test_few_of_all_pairs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(nearest, "DIRECT", 0)
    monkeypatch.setattr(nearest, "MOST", 64)
    d = spark.range(12_000).select("id", F.lit("a").alias("block"), (F.col("id") % 4 == 0).cast("int").alias("treated"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.randn(1)).alias("x1"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.randn(2) * 9).alias("x2"))
    pairs = []
    got = matching.match_mahalanobis(d, "id", "treated", "block", "x1", "x2", pairs=pairs)
    assert got.count() == 3000
    assert 3000 < sum(pairs) < 0.05 * 3000 * 9000


def test_nothing_to_match(spark):
    d = spark.createDataFrame(units(3, 60), SCHEMA)
    assert matching.match_mahalanobis(d.limit(0), "id", "treated", "block", "x1", "x2").collect() == []
    assert matching.match_mahalanobis(d.where("treated = 1"), "id", "treated", "block", "x1", "x2").collect() == []
    flat = matching.match_euclid(d.where("treated = 1").withColumn("x1", F.lit(2.0)), d.where("treated = 0").withColumn("x1", F.lit(2.0)), ["block"], ["x1"], n=1).collect()
    assert flat and all(r["dist"] == 0 for r in flat)
