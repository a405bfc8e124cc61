"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree has three levels: regions, their racks, their shards. Every node has a weight; a row descends from the root
and at each level draws, for every child, ``-ln(u) / weight`` with u a hash of (key, child's name), and goes to the
child with the least draw. A child's chance is its share of the weight, and a draw depends on that child alone, so a
changed weight moves rows only from or to the subtree it belongs to.

A new shard is added as a region of its own (one rack, one shard). All other draws at the top stay as they were, so
each row either stays in its shard or moves into the new one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of one (shard, bucket) cell, about: the unit in which slots are counted.
CELL_ROWS = 20_000


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def base_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> tuple[Shard, ...]:
    """An even tree; shards are numbered from 0 across racks and regions."""
    return tuple(
        Shard(r, r * racks + k, (r * racks + k) * shards + s) for r in range(regions) for k in range(racks) for s in range(shards)
    )


def grown(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """The tree with one more shard, alone in a new rack of a new region."""
    return (*tree, Shard(max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, max(s.shard for s in tree) + 1, weight))


def reweighted(tree: tuple[Shard, ...], shard: int, weight: float) -> tuple[Shard, ...]:
    return tuple(Shard(s.region, s.rack, s.shard, weight if s.shard == shard else s.weight) for s in tree)


def _draw(key: Column, level: str, children: Column) -> Column:
    """The child with the least weighted draw; children: array of (id, weight)."""

    def score(c: Column) -> Column:
        # 53 bits of the hash, at the middle of their step: strictly between 0 and 1
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), c["id"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["id"].alias("id"))

    return F.array_min(F.transform(children, score))["id"]


def _children(pairs: list[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in pairs])


def place(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard of each key."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("the tree has no shard with a weight above 0")
    region: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, list[tuple[int, float]]] = {}
    for s in live:
        region[s.region] = region.get(s.region, 0) + s.weight
        of = racks.setdefault(s.region, {})
        of[s.rack] = of.get(s.rack, 0) + s.weight
        shards.setdefault(s.rack, []).append((s.shard, s.weight))

    def by(parent: Column, table: dict[int, list[tuple[int, float]]]) -> Column:
        return F.element_at(F.create_map(*[x for k, v in sorted(table.items()) for x in (F.lit(k), _children(sorted(v)))]), parent)

    r = _draw(key, "region", _children(sorted(region.items())))
    k = _draw(key, "rack", by(r, {k: list(v.items()) for k, v in racks.items()}))
    return _draw(key, "shard", by(k, shards))


def shard_documents(docs: DataFrame, tree: tuple[Shard, ...] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1 (null: 1). text_crc32: of the text's UTF-8, 0 if null or empty. A null key is
    placed like any other value. Rows with equal keys share a shard and have slots of their own. Slots run from 0
    within each shard, without gaps. Other columns are ignored, whatever their names.

    Slots are counted in cells of about CELL_ROWS rows: rows are ranked inside (shard, bucket) and the cell's start is
    a running sum over the cells' counts, so no task gets a whole shard.
    """
    tree = tree or base_tree()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    shard = place(F.col("doc_id"), tree)
    cells = max(8, docs.count() // CELL_ROWS // len(tree) + 1)
    # by id, size and text, so that unlike rows of one id stand in many cells
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("slot")), F.lit(cells)).cast("int")
    w = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    placed = rows.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        shard.cast("int").alias("shard"),
        place(F.col("doc_id"), grown(tree)).cast("int").alias("grown_shard"),
    )
    placed = written(placed.withColumn("bucket", bucket), "placed")  # a few numbers a row, read for the ranks and for the counts
    ranked = placed.withColumn("r", F.row_number().over(w))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranked.join(starts, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("r") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
