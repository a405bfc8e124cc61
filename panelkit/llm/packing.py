"""Conflict-constrained best-fit packing of documents into training sequences.

Documents go to bins of CAPACITY words. No two documents of one source and no two copies of one text (one duplicate
cluster) share a bin. A document longer than a bin is cut into full bins and a rest, which is packed like any other.

Rows are dealt by a hash of doc_id to groups of about GROUP documents, each packed by best fit in order of falling
size. A bin carries two bitmaps, one of its sources and one of its duplicate clusters, numbered within the group. Bins
are ordered by the room they have left; the search starts at the tightest bin with room for the document and goes on
to its successors until one is compatible, else a bin is opened. Groups do not share bins, so memory is bounded by a
group and the work grows in proportion to the input; at most the last, emptiest bins of a group pay for that.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, GROUP = 2048, 4096


def word_count(text: str = "text") -> Column:
    """Words of the text; null: 0."""
    n = F.size(F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"))
    return F.when(F.coalesce(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == "", 0).otherwise(n).cast("long")


def best_fit(items: list[tuple[int, int | None, int | None]], capacity: int) -> list[int]:
    """The bin of each item (size, source, cluster), in order of falling size; ties in the order given.

    A source or cluster of None conflicts with nothing. Size 0 fits anywhere that is compatible.
    """
    numbers: dict[tuple[int, object], int] = {}
    used = [0, 0]

    def mask(kind: int, x) -> int:
        if x is None:
            return 0
        if (kind, x) not in numbers:
            numbers[kind, x] = used[kind]
            used[kind] += 1
        return 1 << numbers[kind, x]

    order = sorted(range(len(items)), key=lambda i: -items[i][0])
    out = [0] * len(items)
    room: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    for i in order:
        size, source, cluster = items[i]
        s, c = mask(0, source), mask(1, cluster)
        at = bisect_left(room, (size, -1))
        while at < len(room) and (sources[room[at][1]] & s or clusters[room[at][1]] & c):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        insort(room, (left - size, b))
        out[i] = b
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, size: Column | None = None) -> DataFrame:
    """doc_id, text_hash, piece, pack_group, bin, first, size, offset, bin_used.

    first: place of the piece's first word in its document; offset: place of its first word in its bin, whose pieces
    follow each other in order of (doc_id, piece), so offsets and sizes are the boundaries to train with (see
    packed_texts()). One row per piece; every document has at least one, an empty or null text one of size 0. Pieces of one document
    may share a bin with none of its source, so with none of each other. A null source conflicts with nothing; copies
    are rows with equal text (nulls are no copies of each other). Rows with equal doc_id are packed as rows of their
    own. An empty table gives no rows. size: another measure of a row than words. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(size if size is not None else word_count(), F.lit(0)).cast("long").alias("n"),
        source.alias("source"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("cluster"),
    )
    groups = max(1, -(-docs.count() // group))
    # by id and text, so that unlike rows of one id, or without one, are dealt out too
    key = F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)).cast("int")

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "text_hash", "piece", "pack_group", "bin", "first", "size", "offset", "bin_used"]

        def done(of, rows):
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or 0))
            pieces = []  # (doc_id, piece, first, size, source, cluster)
            for doc_id, n, source, cluster in rows:
                for k in range(max(1, -(-n // capacity))):
                    pieces.append((doc_id, k, k * capacity, min(capacity, n - k * capacity), source, cluster))
            bins = best_fit([(p[3], p[4], p[5]) for p in pieces], capacity)
            total = [0] * (max(bins) + 1)
            for p, b in zip(pieces, bins, strict=True):
                total[b] += p[3]
            filled, out = [0] * len(total), []
            for p, b in zip(pieces, bins, strict=True):  # in order of (doc_id, piece)
                out.append((p[0], p[5], p[1], of, b, p[2], p[3], filled[b], total[b]))
                filled[b] += p[3]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        of, held = None, []
        for b in batches:
            for g, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if g != of:
                    if held:
                        yield done(of, held)
                    of, held = g, []
                held.append(row)
        if held:
            yield done(of, held)

    dealt = rows.select(key.alias("g"), "doc_id", "n", "source", "cluster").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "doc_id long, text_hash long, piece int, pack_group int, bin int, first long, size long, offset long, bin_used long")


def packed_texts(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """pack_group, bin, doc_ids, offsets, text: the words of each bin, one space between them, and where each piece begins.

    packed: what pack_documents(docs) gave, in words. Rows that agree in doc_id and text stand for each other.
    """
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))) & F.xxhash64("text").eqNullSafe(F.col("__t"))
    texts = docs.select("doc_id", "text").distinct()
    pieces = packed.where("size > 0").withColumnsRenamed({"doc_id": "__id", "text_hash": "__t"})
    words = F.slice(F.split(F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"), (F.col("first") + 1).cast("int"), F.col("size").cast("int"))
    x = texts.join(pieces, same).select("pack_group", "bin", F.struct("offset", F.col("__id").alias("doc_id"), F.array_join(words, " ").alias("words")).alias("p"))
    x = x.groupBy("pack_group", "bin").agg(F.array_sort(F.collect_list("p")).alias("p"))  # a bin's words at most
    return x.select("pack_group", "bin", F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"), F.array_join("p.words", " ").alias("text"))
