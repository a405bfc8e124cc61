"""Measures of documents: citations, quality, novelty of class pairs, exploration, teams and careers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .quantiles import quantiles_by
from .stages import dealt


def forward_citations(edges: DataFrame, citing: str, cited: str) -> DataFrame:
    """cited, forward_citations: distinct citing documents."""
    return edges.where(F.col(cited).isNotNull()).groupBy(cited).agg(F.countDistinct(citing).alias("forward_citations"))


def quality_bins(docs: DataFrame, count: str, by: list[str], levels: tuple[float, float] = (0.9, 0.99), external: bool = False) -> DataFrame:
    """docs with top1, top10_to_2, cited, uncited by exact group quantiles of the count.

    A missing count is 0. With external=True it stays missing (all four NULL) and the middle bin needs no positive count.
    """
    c = F.col(count) if external else F.coalesce(F.col(count), F.lit(0))
    q = docs.withColumn("__c", c).where(" and ".join(f"{b} is not null" for b in by))
    q = quantiles_by(q, by, "__c", list(levels)).withColumnRenamed("q", "__q")
    d = docs.join(q, by, "left").withColumn("__c", c)
    lo, hi, x = F.col("__q")[0], F.col("__q")[1], F.col("__c")
    flag = lambda cond: F.when(x.isNotNull() if external else F.lit(True), F.coalesce(cond, F.lit(False)).cast("int"))
    return d.withColumns(
        {
            "top1": flag((x > 0) & (x >= hi)),
            "top10_to_2": flag((x >= lo) & (x < hi) & (F.lit(True) if external else x > 0)),
            "cited": flag((x > 0) & (x < lo)),
            "uncited": flag(x == 0),
        }
    ).drop("__q", "__c")


def pair_novelty(docs: DataFrame, doc: str, date: str, cls: str, max_classes: int | None = None) -> DataFrame:
    """doc, new_pairs, total_pairs, novelty: the share of the document's class pairs that no earlier document had.

    A pair is new for every document of its first date. Pairs are made inside a document only (its classes are few);
    max_classes guards against documents with very many. Documents with fewer than two classes have 0 of 0.
    """
    per = docs.where(F.col(doc).isNotNull()).groupBy(doc, date).agg(F.array_sort(F.collect_set(cls)).alias("s"))
    if max_classes:
        per = per.withColumn("s", F.slice("s", 1, max_classes))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.greatest(F.size("s") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    long = per.where(F.size("s") > 1).select(doc, date, F.explode(pairs).alias("p")).where(F.col(date).isNotNull())
    # the first date of a pair is an aggregate (combined before the shuffle); a common pair never gathers in one task
    first = long.groupBy("p").agg(F.min(date).alias("__first"))
    new = long.join(first, "p").groupBy(doc).agg(F.sum((F.col(date) == F.col("__first")).cast("int")).alias("new_pairs"), F.count("*").alias("total_pairs"))
    out = docs.select(doc).where(F.col(doc).isNotNull()).distinct().join(new, doc, "left").fillna(0, ["new_pairs", "total_pairs"])
    return out.withColumn("novelty", F.coalesce(ratio(F.col("new_pairs"), F.col("total_pairs")), F.lit(0.0)))


def citation_links(edges: DataFrame, owners: DataFrame, citing: str, cited: str, doc: str, owner: str) -> DataFrame:
    """citing, backward, self_citations: distinct cited documents, and those that share an owner with the citing one."""
    e = edges.select(F.col(citing).alias("x"), F.col(cited).alias("y")).dropna().distinct()
    o = owners.select(F.col(doc).alias("d"), F.col(owner).alias("o")).dropna().distinct()
    own = e.join(o.toDF("x", "o"), "x").join(o.toDF("y", "o"), ["y", "o"]).select("x", "y").distinct().groupBy("x").agg(F.count("*").alias("self_citations"))
    return e.groupBy("x").agg(F.count("*").alias("backward")).join(own, "x", "left").fillna(0, ["self_citations"]).withColumnRenamed("x", citing)


def exploration(docs: DataFrame, doc: str, year: str, cls: str, actor: str, window: int = 5) -> DataFrame:
    """doc, exploration, exploitation: the share of the document's classes that none of its actors had in the last years.

    An actor knows a class if an earlier document of its own (by year, then id) within the window has it: the document
    just before, in the actor's sequence for that class, is the latest of these, so one lag decides. Documents without
    an actor know nothing: exploration 1.
    """
    rows = docs.where(F.col(doc).isNotNull() & F.col(year).isNotNull() & F.col(cls).isNotNull())
    by_actor = dealt(rows.where(F.col(actor).isNotNull()).select(actor, doc, year, cls), actor, cls).distinct()
    before = F.lag(year).over(Window.partitionBy(actor, cls).orderBy(year, doc))
    known = by_actor.select(doc, cls, F.coalesce(before >= F.col(year) - window, F.lit(False)).alias("k"))
    every = dealt(known.unionByName(rows.where(F.col(actor).isNull()).select(doc, cls, F.lit(False).alias("k"))), doc)
    share = every.groupBy(doc, cls).agg(F.max("k").alias("k")).groupBy(doc).agg(F.avg(F.col("k").cast("double")).alias("exploitation"))
    return share.select(doc, (1 - F.col("exploitation")).alias("exploration"), "exploitation")


def career(rows: DataFrame, person: str, doc: str, year: str, cls: str, order: list[str]) -> DataFrame:
    """rows with team_size, first_year, first_class, age and same_first_class (false where either class is missing)."""
    rows = dealt(rows, doc)
    team = rows.groupBy(doc).agg(F.countDistinct(person).alias("team_size"))
    key = F.struct(*order)
    first = dealt(rows.select(*dict.fromkeys([person, year, cls, *order])), person).groupBy(person).agg(F.min_by(F.when(F.col(cls).isNotNull(), F.col(cls)), F.when(F.col(cls).isNotNull(), key)).alias("first_class"), F.min(year).alias("first_year"))
    out = dealt(rows.join(team, doc, "left"), person).join(first, person, "left")
    age = F.col(year) - F.col("first_year")
    return out.withColumn("age", F.when(age >= 0, age)).withColumn("same_first_class", F.coalesce(F.col(cls) == F.col("first_class"), F.lit(False)).cast("int"))
