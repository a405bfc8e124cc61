"""Matching of treated and control units within blocks, on lists of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nearest import nearest
from .stages import stage
from .windows import first_by, top_by


def propensity(pool: DataFrame, label: str, numeric: list[str], categorical: list[str] | None = None, name: str = "pscore", standardise: bool = False) -> DataFrame:
    """pool with the probability of treatment: a balanced logistic regression with a unit ridge penalty; NULL with one class only.

    The penalty on the mean loss is 1 over the summed weights; rows with a missing number get no score.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    categorical = categorical or []
    n = {r[label]: r["n"] for r in pool.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return pool.withColumn(name, F.lit(None).cast("double"))
    x = pool.dropna(subset=numeric).withColumn("__w", F.when(F.col(label) == 1, sum(n.values()) / (2 * n[1])).otherwise(sum(n.values()) / (2 * n[0])))
    parts = []
    for c in categorical:
        x = StringIndexer(inputCol=c, outputCol=f"__i_{c}", handleInvalid="keep").fit(x).transform(x)
        x = OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"__o_{c}", dropLast=True).fit(x).transform(x)
        parts.append(f"__o_{c}")
    x = VectorAssembler(inputCols=numeric, outputCol="__num").transform(x)
    if standardise:
        x = StandardScaler(inputCol="__num", outputCol="__std", withMean=True, withStd=True).fit(x).transform(x)
    x = VectorAssembler(inputCols=["__std" if standardise else "__num", *parts], outputCol="__f").transform(x)
    model = LogisticRegression(featuresCol="__f", labelCol=label, weightCol="__w", regParam=1 / sum(n.values()), standardization=False, maxIter=200, tol=1e-9, predictionCol="__p", rawPredictionCol="__r", probabilityCol="__q").fit(x)
    out = model.transform(x).withColumn(name, vector_to_array("__q")[1])
    return out.select(*pool.columns, name).unionByName(pool.where(" or ".join(f"{c} is null" for c in numeric)).withColumn(name, F.lit(None).cast("double")))


def match_mahalanobis(pool: DataFrame, entity: str, treated: str, block: str, x1: str, x2: str, caliper: float | None = None, score: str | None = None, pairs: list | None = None) -> DataFrame:
    """entity, control, block, distance: each treated unit's nearest control of its block, ties to the least id.

    The distance uses the block's pooled 2 x 2 covariance, its inverse in closed form. With a caliper the scores may
    differ by so much at most; missing scores pass. Blocks without a positive determinant have no distances. Neighbours
    are searched in coordinates that the covariance has whitened (see nearest).
    """
    p = pool.dropna(subset=[entity, block, x1, x2]).select(F.col(entity).alias("id"), F.col(block).alias("__b"), F.col(treated).alias("__t"), F.col(x1).cast("double").alias("__x1"), F.col(x2).cast("double").alias("__x2"), *([F.col(score).alias("__s")] if score else []))
    cov = p.groupBy("__b").agg((F.var_samp("__x1") + 1e-8).alias("__va"), F.covar_samp("__x1", "__x2").alias("__vb"), (F.var_samp("__x2") + 1e-8).alias("__vc"))
    cov = cov.withColumn("__det", F.col("__va") * F.col("__vc") - F.col("__vb") * F.col("__vb")).where("__det > 0")
    q = p.join(cov, "__b").withColumns({"__u1": F.col("__x1") / F.sqrt("__va"), "__u2": (F.col("__x2") - F.col("__vb") / F.col("__va") * F.col("__x1")) / F.sqrt(F.col("__det") / F.col("__va"))})
    d1, d2 = F.col("t.__x1") - F.col("c.__x1"), F.col("t.__x2") - F.col("c.__x2")
    va, vb, vc = (F.col(f"t.__v{x}") for x in "abc")
    dist = F.sqrt(F.greatest((vc * d1 * d1 - 2 * vb * d1 * d2 + va * d2 * d2) / F.col("t.__det"), F.lit(0.0)))
    near = F.coalesce(F.abs(F.col("t.__s") - F.col("c.__s")) <= caliper, F.lit(True)) if caliper is not None and score else None
    data = ["__x1", "__x2", "__va", "__vb", "__vc", "__det", *(["__s"] if score else [])]
    got = nearest(q.where("__t = 1"), q.where("__t = 0"), ["__b"], ["__u1", "__u2"], dist, 1, data, near, pairs=pairs)
    return got.select(F.col("id").alias(entity), "control", F.col("__b").alias(block), "distance")


def match_cohorts(df: DataFrame, entity: str, time: str, g: str, block: str, x1: str, x2: str, caliper: float | None = None) -> DataFrame:
    """cohort, entity, control, distance: cohort by cohort on the year before, controls (g = 0) used by one cohort are gone for the next.

    The loop runs over cohorts, a few dozen; each round's pool and pairs are written before the next step reads them. A
    cohort without rows in the year before has no pairs.
    """
    from ..functions.nulls import drop_null_keys

    d = drop_null_keys(df, entity, time).withColumn("__g", F.coalesce(F.col(g), F.lit(0)).cast("long"))
    # all that any cohort reads: controls, and treated units in the year before
    d = stage(d.where((F.col("__g") == 0) | (F.col(time) == F.col("__g") - 1)).select(*dict.fromkeys([entity, time, "__g", block, x1, x2])), "cohorts")
    used, out = None, None
    for c in sorted(r["__g"] for r in d.where("__g > 0").select("__g").distinct().collect()):
        pool = d.where((F.col(time) == c - 1) & F.col("__g").isin(0, c)).withColumn("__t", (F.col("__g") > 0).cast("int"))
        if used is not None:
            pool = pool.join(used, entity, "left_anti")
        m = match_mahalanobis(stage(pool, "pool"), entity, "__t", block, x1, x2, caliper).withColumn("cohort", F.lit(c))
        m = stage(m, "pairs")
        out = m if out is None else out.unionByName(m)
        now = m.select(F.col("control").alias(entity)).distinct()
        used = now if used is None else used.union(now)
    if out is None:
        kind = dict(df.dtypes)
        return df.sparkSession.createDataFrame([], f"`{entity}` {kind[entity]}, control {kind[entity]}, `{block}` {kind[block]}, distance double, cohort int")
    return out


def candidates(treated: DataFrame, controls: DataFrame, exact: list[str], score: str, caliper: float | None, spans: list[tuple[str, int]]) -> DataFrame:
    """tid, cid, exact columns, dist: pairs of the same exact columns within caliper and tolerances.

    With a caliper, scores are cut into steps of its width, and a unit meets controls of its own and both neighbouring
    steps only; so a large exact cell is never joined as a whole.
    """
    t, c = treated, controls
    keys = list(exact)
    if caliper:
        step = F.floor(F.col(score) / F.lit(caliper)).cast("long")
        t = t.withColumn("__step", F.explode(F.array(step - 1, step, step + 1)))
        c = c.withColumn("__step", step)
        keys.append("__step")
    t, c = t.alias("t"), c.alias("c")
    on = F.lit(True)
    for x in keys:
        on = on & (F.col(f"t.{x}") == F.col(f"c.{x}"))
    for x, tolerance in spans:
        on = on & (F.abs(F.col(f"t.{x}") - F.col(f"c.{x}")) <= tolerance)
    dist = F.abs(F.col(f"t.{score}") - F.col(f"c.{score}"))
    if caliper is not None:
        on = on & (dist <= caliper)
    return t.join(c, on).where(F.col("t.id") != F.col("c.id")).select(F.col("t.id").alias("tid"), F.col("c.id").alias("cid"), *[F.col(f"t.{x}") for x in exact], dist.alias("dist"))


#: Treated units of an exact cell that are walked together.
WALK = 256


def match_greedy(pairs: DataFrame, exact: list[str], n: int = 3, max_reuse: int | None = 10) -> DataFrame:
    """tid, cid, exact columns, control_rank, dist: n nearest controls per treated unit, in order of treated ids.

    A control is used at most max_reuse times within its exact cell, by the treated units with the least ids that want
    it: a walk in order of treated ids. It is walked in batches of WALK units of each cell. Those before a unit in its
    batch fill at most n * (WALK - 1) controls, so its picks are among its first n * WALK candidates that were not full
    when the batch began; a task holds these lists of one cell's batch and no more. Without a cap it is a ranking.
    """
    mine = Window.partitionBy("tid", *exact).orderBy("dist", "cid")
    left = pairs.select("tid", "cid", *exact, "dist").distinct()
    if max_reuse is None:
        return left.withColumn("control_rank", F.row_number().over(mine)).where(F.col("control_rank") <= n).select("tid", "cid", *exact, "control_rank", "dist")
    left = stage(left, "candidates")
    place = F.row_number().over(Window.partitionBy(*exact).orderBy("tid")) - 1
    units = left.select("tid", *exact).distinct().withColumn("__batch", F.floor(place / WALK).cast("int"))
    left = stage(left.join(stage(units, "units"), ["tid", *exact]).repartitionByRange("__batch", "tid"), "batches")
    last = left.agg(F.max("__batch")).first()[0]
    columns = ["tid", "cid", *exact, "control_rank", "dist"]
    kinds = dict(left.dtypes) | {"control_rank": "int"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def walk(pdf):
        pdf = pdf.sort_values(["tid", "dist", "cid"], kind="stable")
        used, kept, ranks, now = dict(zip(pdf["cid"], pdf["__used"], strict=True)), [], [], None
        for i, (tid, cid) in enumerate(zip(pdf["tid"], pdf["cid"], strict=True)):
            if tid != now:
                now, taken = tid, 0
            if taken < n and used[cid] < max_reuse:
                used[cid] += 1
                taken += 1
                kept.append(i)
                ranks.append(taken)
        return pdf.iloc[kept].assign(control_rank=ranks)[columns]

    out = None
    for batch in range(0 if last is None else last + 1):
        asked = left.where(F.col("__batch") == batch).withColumn("__used", F.lit(0).cast("long"))
        if out is not None:
            uses = out.groupBy("cid", *exact).agg(F.count("*").alias("__n"))
            asked = asked.drop("__used").join(uses, ["cid", *exact], "left").withColumn("__used", F.coalesce("__n", F.lit(0).cast("long"))).drop("__n")
        first = asked.where(F.col("__used") < max_reuse).withColumn("__r", F.row_number().over(mine)).where(F.col("__r") <= n * WALK)
        picks = stage(first.drop("__r", "__batch").groupBy(*exact).applyInPandas(walk, schema), "picks")
        out = picks if out is None else out.unionByName(picks)
    return left.sparkSession.createDataFrame([], schema) if out is None else out


def match_euclid(treated: DataFrame, controls: DataFrame, block: list[str], x: list[str], category: str | None = None, n: int = 3, pairs: list | None = None) -> DataFrame:
    """tid, cid, dist, control_rank: the n nearest by standardised squared distance, 2 more where the category differs.

    A column without spread tells nothing, nor does one that is missing on either side. Units with all columns are
    searched by nearest; those that lack one are compared with all controls of their block, and controls that lack one
    with all treated.
    """
    s = treated.select("id", *x).unionByName(controls.select("id", *x)).agg(*[F.stddev_pop(c).alias(f"__s{i}") for i, c in enumerate(x)])
    spreads = [s.first()[i] for i in range(len(x))]  # one row
    kept = [(c, v) for c, v in zip(x, spreads, strict=True) if v]
    d = sum((F.coalesce(F.pow((F.col(f"t.{c}") - F.col(f"c.{c}")) / F.lit(v), F.lit(2)), F.lit(0.0)) for c, v in kept), F.lit(0.0))
    if category:
        d = d + F.when(F.col(f"t.{category}") != F.col(f"c.{category}"), 2.0).otherwise(0.0)
    scaled = lambda df: df.withColumns({f"__u{i}": F.col(c) / F.lit(v) for i, (c, v) in enumerate(kept)} | ({} if kept else {"__u0": F.lit(0.0)}))
    u = [f"__u{i}" for i in range(max(1, len(kept)))]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in u])
    t, c = scaled(treated), scaled(controls)
    data = [*(name for name, _ in kept), *([category] if category else [])]
    got = nearest(t.where(whole), c.where(whole), block, u, F.sqrt(d), n, data, penalty=2.0 if category else 0.0, pairs=pairs).select(F.col("id").alias("tid"), F.col("control").alias("cid"), F.col("distance").alias("dist"))
    for a, b in ((t.where(~whole), c), (t.where(whole), c.where(~whole))):
        j = a.alias("t").join(b.alias("c"), [F.col(f"t.{k}") == F.col(f"c.{k}") for k in block]).where(F.col("t.id") != F.col("c.id"))
        got = got.unionByName(j.select(F.col("t.id").alias("tid"), F.col("c.id").alias("cid"), F.sqrt(d).alias("dist")))
    w = Window.partitionBy("tid").orderBy("dist", "cid")
    return top_by(got, ["tid"], ["dist", "cid"], n).withColumn("control_rank", F.row_number().over(w))


def stack_cohorts(df: DataFrame, pairs: DataFrame, entity: str, time: str, g: str, lo: int, hi: int, dedupe: bool = True) -> DataFrame:
    """All rows of matched units in their cohort's window, tagged with cohort, event_time, treated and post; a unit-year stays in its first cohort."""
    ids = pairs.select("cohort", F.col(entity).alias("__id")).union(pairs.select("cohort", F.col("control").alias("__id"))).distinct()
    x = df.join(ids, df[entity] == ids["__id"]).drop("__id").where((F.col(time) - F.col("cohort")).between(lo, hi))
    x = x.withColumn("event_time", F.col(time) - F.col("cohort")).withColumn("treated", (F.coalesce(F.col(g), F.lit(0)) == F.col("cohort")).cast("int"))
    x = x.withColumn("post", (F.col("event_time") >= 0).cast("int")).withColumn("post_treated", F.col("treated") * F.col("post"))
    return first_by(x, [entity, time], ["cohort", F.desc("treated")]) if dedupe else x


def attach_control_firm(events: DataFrame, panel: DataFrame, unit: str, at: str, year: str, firm: str, name: str = "control_firm") -> DataFrame:
    """The unit's firm in the event year, else in the year before."""
    p = panel.select(unit, F.col(year).alias("__y"), F.col(firm).alias("__f"))
    now = p.select(unit, F.col("__y").alias(at), F.col("__f").alias("__now"))
    before = p.select(unit, (F.col("__y") + 1).alias(at), F.col("__f").alias("__before"))
    return events.join(now, [unit, at], "left").join(before, [unit, at], "left").withColumn(name, F.coalesce("__now", "__before")).drop("__now", "__before")
