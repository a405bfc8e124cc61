"""Cosine similarity of class-count vectors, kept as long rows (entity, year, class, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .stages import dealt, stage


def class_counts(rows: DataFrame, entity: str, year: str, cls: str, doc: str | None = None) -> DataFrame:
    """e, y, c, n: rows, or distinct documents if doc is given, of each class."""
    x = rows.where(F.col(entity).isNotNull() & F.col(year).isNotNull() & F.col(cls).isNotNull())
    n = F.countDistinct(doc) if doc else F.count("*")
    return x.groupBy(F.col(entity).alias("e"), F.col(year).alias("y"), F.col(cls).alias("c")).agg(n.alias("n"))


def vectors_in_windows(keys: DataFrame, counts: DataFrame, entity: str, at: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """keys' columns, c and one column per window: the summed vector of keys[entity] over the years at+lo to at+hi. One join for all windows."""
    rel = F.col("__y") - F.col(at)
    wide = rel.between(min(lo for lo, _ in windows.values()), max(hi for _, hi in windows.values()))
    x = keys.join(counts.toDF("__e", "__y", "c", "n"), (F.col("__e") == F.col(entity)) & wide).withColumn("__rel", rel)
    return x.groupBy(*keys.columns, "c").agg(*[F.sum(F.when(F.col("__rel").between(lo, hi), F.col("n"))).cast("double").alias(k) for k, (lo, hi) in windows.items()])


def cosines(tables: list[DataFrame], keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """keys and one cosine per pair of vectors, the columns of the tables; NULL where either is empty."""
    vectors = sorted({v for p in pairs.values() for v in p})
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    wide = wide.groupBy(*keys, "c").agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in vectors])
    sums = wide.groupBy(*keys).agg(
        *[F.sum(F.col(v) * F.col(v)).alias(f"__{v}") for v in vectors], *[F.sum(F.col(a) * F.col(b)).alias(f"__dot_{k}") for k, (a, b) in pairs.items()]
    )
    return sums.select(*keys, *[F.try_divide(F.col(f"__dot_{k}"), F.sqrt(F.col(f"__{a}") * F.col(f"__{b}"))).alias(k) for k, (a, b) in pairs.items()])


def event_proximity(moves: DataFrame, rows: DataFrame, unit: str, firm: str, year: str, cls: str, doc: str, window: int = 5) -> DataFrame:
    """Seven cosines per move (unit, move_year, from_state, to_state): pre [m-window+1, m], post [m+1, m+window], distinct documents."""
    m = moves.select(F.col(unit).alias("u"), F.col("move_year").alias("m"), F.col("from_state").alias("f"), F.col("to_state").alias("t")).distinct()
    own, firms = class_counts(rows, unit, year, cls, doc), class_counts(rows, firm, year, cls, doc)
    keys = ["u", "m", "f", "t"]
    m, own, firms = stage(m, "moves"), stage(own, "own"), stage(firms, "firms")
    v = [vectors_in_windows(m, counts, col, "m", {f"{who}_pre": (1 - window, 0), f"{who}_post": (1, window)}) for who, col, counts in (("inv", "u", own), ("from", "f", firms), ("to", "t", firms))]
    pairs = {"inv_pre_post": ("inv_pre", "inv_post"), "from_pre_post": ("from_pre", "from_post"), "to_pre_post": ("to_pre", "to_post"), "inv_from_pre": ("inv_pre", "from_pre"), "inv_to_pre": ("inv_pre", "to_pre"), "inv_to_post": ("inv_post", "to_post"), "from_to_pre": ("from_pre", "to_pre")}
    return m.join(cosines(v, keys, pairs), keys, "left").withColumnsRenamed({"u": unit, "m": "move_year", "f": "from_state", "t": "to_state"})


def rolling_similarity(moves: DataFrame, rows: DataFrame, unit: str, firm: str, year: str, cls: str, window: int = 5, history: str = "active") -> DataFrame:
    """Five cosines per move and year in which the unit is active: histories over [y-window, y-1], rows counted.

    history='active': firms' histories hold only years in which the unit was active; 'all': every year.

    A unit's own vectors depend on the year alone and those of a place on the unit and the year, so each is made once
    for all moves; moves meet sums only. Rows are dealt by unit.
    """
    m = moves.select(F.col(unit).alias("u"), F.col("from_state").alias("f"), F.col("to_state").alias("t")).distinct()
    own, firms = stage(class_counts(rows, unit, year, cls), "own"), stage(class_counts(rows, firm, year, cls), "firms")
    m = stage(m, "moves")
    mine = dealt(own.join(m.select(F.col("u").alias("e")).distinct(), "e", "left_semi").withColumnRenamed("e", "u"), "u")
    active = mine.select("u", "y").distinct()
    n, at = F.col("n").cast("double"), (F.col("y") + F.col("rel")).cast(dict(own.dtypes)["y"]).alias("at")
    seen = mine.withColumn("rel", F.explode(F.sequence(F.lit(0), F.lit(window))))
    vectors = seen.groupBy("u", at, "c").agg(F.coalesce(F.sum(F.when(F.col("rel") == 0, n)), F.lit(0.0)).alias("now"), F.coalesce(F.sum(F.when(F.col("rel") > 0, n)), F.lit(0.0)).alias("hist"))
    square = lambda a, b, name: F.sum(F.col(a) * F.col(b)).alias(name)
    alone = vectors.groupBy("u", "at").agg(square("now", "now", "nn"), square("hist", "hist", "hh"), square("now", "hist", "nh")).where("nn > 0")
    places = dealt(m.select("u", F.explode(F.array("f", "t")).alias("p")).distinct(), "u")
    if history == "active":
        # a year of the unit is in the histories of the years after it
        held = places.join(active, "u").join(firms.toDF("p", "y", "c", "n"), ["p", "y"])
        held = held.withColumn("rel", F.explode(F.sequence(F.lit(1), F.lit(window)))).groupBy("u", "p", at, "c").agg(F.sum(n).alias("place"))
    else:
        held = vectors_in_windows(places.join(active.withColumnRenamed("y", "at"), "u"), firms, "p", "at", {"place": (-window, -1)})
    with_place = held.join(vectors, ["u", "at", "c"], "left").groupBy("u", "p", "at").agg(square("place", "place", "pp"), square("now", "place", "np"), square("hist", "place", "hp"))
    sums = stage(with_place, "places")
    x = m.join(stage(alone, "alone"), "u")
    for c in ("f", "t"):
        x = x.join(sums.select("u", F.col("p").alias(c), "at", *[F.col(v).alias(f"{v}_{c}") for v in ("pp", "np", "hp")]), ["u", c, "at"], "left")
    cosine = lambda dot, a, b, name: F.try_divide(F.coalesce(dot, F.lit(0.0)), F.sqrt(F.col(a) * F.col(b))).alias(name)
    pairs = [("inv_self", "nh", "nn", "hh"), ("inv_from", "np_f", "nn", "pp_f"), ("inv_to", "np_t", "nn", "pp_t"), ("hist_from", "hp_f", "hh", "pp_f"), ("hist_to", "hp_t", "hh", "pp_t")]
    return x.select(F.col("u").alias(unit), F.col("f").alias("from_state"), F.col("t").alias("to_state"), F.col("at").alias(year), *[cosine(F.col(dot), a, b, name) for name, dot, a, b in pairs])


def rolling_self_similarity(rows: DataFrame, entity: str, year: str, cls: str, window: int = 5) -> DataFrame:
    """entity, year, similarity: cosine of the year's classes with those of the window before; years without a history are left out."""
    x = dealt(rows.select(entity, year, cls).where(F.col(entity).isNotNull() & F.col(year).isNotNull() & F.col(cls).isNotNull()), entity)
    # a count is part of its own year and of the histories of the years after; a year without rows of its own has no cosine
    seen = class_counts(x, entity, year, cls).withColumn("rel", F.explode(F.sequence(F.lit(0), F.lit(window))))
    n = F.col("n").cast("double")
    both = seen.groupBy("e", (F.col("y") + F.col("rel")).alias("at"), "c").agg(F.sum(F.when(F.col("rel") == 0, n)).alias("now"), F.sum(F.when(F.col("rel") > 0, n)).alias("hist"))
    sums = both.groupBy("e", "at").agg(F.sum(F.col("now") * F.col("hist")).alias("dot"), F.sum(F.col("now") * F.col("now")).alias("a"), F.sum(F.col("hist") * F.col("hist")).alias("b"))
    cosine = F.coalesce("dot", F.lit(0.0)) / F.sqrt(F.col("a") * F.col("b"))
    return sums.where("a > 0 AND b > 0").select(F.col("e").alias(entity), F.col("at").cast(dict(rows.dtypes)[year]).alias(year), cosine.alias("similarity"))


def pairwise_similarity(events: DataFrame, rows: DataFrame, a: str, b: str, at: str, entity: str, year: str, cls: str, doc: str, window: int = 5) -> DataFrame:
    """events' (a, b, at) with similarity of both parties over [at-window+1, at], distinct documents."""
    k = events.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(at).alias("at")).distinct()
    counts = class_counts(rows, entity, year, cls, doc)
    v = [vectors_in_windows(k, counts, n, "at", {f"v{n}": (1 - window, 0)}) for n in ("a", "b")]
    return k.join(cosines(v, ["a", "b", "at"], {"similarity": ("va", "vb")}), ["a", "b", "at"], "left").toDF(a, b, at, "similarity")


def map_cosine(a, b):
    """Cosine of two map<class, count> columns; NULL where either is empty or all zero."""
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(F.element_at(a, k) * F.element_at(b, k), F.lit(0.0)))
    norm = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v)
    return ratio(dot, F.sqrt(norm(a) * norm(b)))
