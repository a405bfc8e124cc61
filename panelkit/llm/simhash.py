"""SimHash fingerprints, linked by Golay-code fuzzy hashing.

A fingerprint is cut into segments of at most 23 bits. Each segment is decoded to nearby codewords of the Golay code,
and a key is a pair of segments with one codeword index each (24 bits). Fingerprints that share a key are compared in
full.

Exact plan (64 bits, radius 3): three segments. Of three segments with at most 3 errors together, two have at most one
error each, and segments one bit apart share an index, so every linked pair shares a key.

Wide plan (256 bits): for similarity joins at larger radius, where no key of code segments finds every pair. Keys are
32 bands of four min-hashes of the text's shingles, so a pair of resemblance r shares one with probability
1 - (1 - r^4)^32. The bits sift the pairs under a key; what passes is estimated by the least hash in each of BINS bins
of the hash range, and pairs whose estimate leaves hardly a chance of the wanted resemblance go no further. Exact
resemblance decides on those that are left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import SLICE, cut, discard, lower_words, shuffle_partitions, written
from .components import components
from .sketch import mixed, shingle_hashes

#: Rows of a cell that are compared with each other. A key with more rows is split into cells of two chunks each.
CELL, WIDE_CELL = 512, 4096  # with the exact and a wide plan
#: Bins of a shingle set's signature, and standard deviations of its estimate that a pair may lie below the limit.
BINS, SLACK = 512, 4.0


@dataclass(frozen=True)
class Plan:
    """How fingerprints are made and linked."""

    words: int  # words per shingle
    lanes: int  # 64-bit lanes of the fingerprint
    radius: int  # linked at so many differing bits or fewer
    segments: tuple[tuple[int, int], ...]  # (first bit, bits)
    pairs: tuple[tuple[int, int], ...]
    bands: int = 0  # keys of BAND min-hashes each; 0: pairs of segments by the exact rule
    similarity: float = 0.0  # least exact resemblance of shingle sets, with bands


EXACT = Plan(3, 1, 3, ((0, 22), (22, 21), (43, 21)), ((0, 1), (0, 2), (1, 2)))


def wide(similarity: float = 0.8, slack: float = 4.0) -> Plan:
    """Links texts whose five-word shingle sets have this resemblance or more.

    The expected share of differing bits is the angle between the sets' indicator vectors over pi; slack standard
    deviations are added, so that pairs at the limit are hardly ever missed.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = round(256 * p + slack * math.sqrt(256 * p * (1 - p)))
    return Plan(5, 4, radius, (), (), 32, similarity)


#: Min-hashes in a key, and the odd factors that order the shingle hashes anew for each.
BAND = 4
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 32 * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band from distinct shingle hashes; no hash: the band's number."""
    low = np.array([(h * f).min() if len(h) else 0 for f in _FACTORS[: bands * BAND]], np.uint64).reshape(bands, BAND)
    out = np.arange(bands, dtype=np.uint64)
    for i in range(BAND):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + low[:, i])
    return out


def signature(h: np.ndarray) -> np.ndarray:
    """One byte per bin of the hash range, from the least hash in it; 0: no hash there. h: distinct hashes in order."""
    out = np.zeros(BINS, np.uint8)
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(h) else bins
    out[bins[first]] = mixed(h[first]) % np.uint64(255) + np.uint64(1)
    return out


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated resemblance of each pair of signatures, whether the sets may reach this similarity).

    na, nb: sizes of the sets. Of the u hashes in either set m stand least in their bin and are compared; the estimate's
    variance is that of m draws from u without replacement.
    """
    filled = (a | b) != 0
    m = filled.sum(axis=1)
    r = ((a == b) & filled).sum(axis=1) / np.maximum(m, 1)
    u = np.maximum((na + nb) / (1 + similarity), m)
    sd = np.sqrt(similarity * (1 - similarity) / np.maximum(m, 1) * np.maximum(1 - m / np.maximum(u, 1), 0.02))
    return np.where(m > 0, r, 1.0), (m == 0) | (r >= similarity - SLACK * sd)


def _string_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each space-joined shingle's UTF-8; A-Z lower-cased; repeats included."""
    w = lower_words(text)
    if not w:
        return np.empty(0, np.uint64)
    join, h = b" ".join, xxhash.xxh64_intdigest
    size = min(size, len(w))
    return np.fromiter((h(join(s), 42) for s in zip(*(w[i:] for i in range(size)))), np.uint64, len(w) - size + 1)


def _majority(h: np.ndarray) -> np.ndarray:
    """The bits (0 or 1) set in over half of the 64-bit hashes, bit 0 first."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 256):
        part = h[at : at + 255 * 256].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return (counts * 2 > len(h)).astype(np.uint8)


def fingerprint(text: str, plan: Plan = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """(lanes of uint64, distinct shingle hashes in order with bands, else none); no word: zeros."""
    if plan.bands:
        h = np.unique(shingle_hashes(text, plan.words))
        hashes = [mixed(h ^ np.uint64(0xA5A5A5A5 * (i + 1))) for i in range(plan.lanes)]
    else:
        h, hashes = np.empty(0, np.uint64), [_string_hashes(text, plan.words)]
    return np.packbits(np.concatenate([_majority(x) for x in hashes]), bitorder="little").view("<u8").copy(), h


def segment_words(lanes: np.ndarray, first: int, bits: int) -> np.ndarray:
    """(rows, lanes) of uint64 to the segment's bits as int32."""
    lane, at = divmod(first, 64)
    w = lanes[:, lane] >> np.uint64(at)
    if at + bits > 64:
        w = w | (lanes[:, lane + 1] << np.uint64(64 - at))
    return (w & np.uint64((1 << bits) - 1)).astype(np.int32)


def keys(lanes: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys): the distinct keys of each fingerprint."""
    index = [golay.one_apart_keys(segment_words(lanes, first, bits)) for first, bits in plan.segments]
    rows, out = [], []
    for k, (i, j) in enumerate(plan.pairs):
        a, b = index[i], index[j]
        key = (k << 24) | (a[:, :, None].astype(np.int64) << 12) | b[:, None, :]
        key = np.sort(key.reshape(len(lanes), -1), axis=1)
        first = np.ones(key.shape, bool)
        first[:, 1:] = key[:, 1:] != key[:, :-1]
        r, _ = np.nonzero(first)
        rows.append(r)
        out.append(key[first])
    return np.concatenate(rows), np.concatenate(out)


_BAND_COLUMNS = ["digest", "bands", "marks", "size"]


def _lane_names(plan: Plan) -> list[str]:
    return [f"f{i}" for i in range(plan.lanes)]


def fingerprints(docs: DataFrame, plan: Plan = EXACT) -> DataFrame:
    """doc_id, f0.. (lanes as signed 64-bit) and, for a wide plan, digest and size of the shingle set, bands (its keys), marks (signature and keys' lower halves)."""

    def run(batches):
        import pyarrow as pa

        for b in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            got = [fingerprint(t.as_py() or "", plan) for t in b.column(1)]
            lanes = np.stack([g[0] for g in got]).view(np.int64)
            cols = [b.column(0), *(pa.array(lanes[:, i]) for i in range(plan.lanes))]
            if plan.bands:
                cols.append(pa.array(np.array([xxhash.xxh3_64_intdigest(g[1].tobytes()) for g in got], np.uint64).view(np.int64)))
                found = [band_keys(g[1], plan.bands) for g in got]
                cols.append(pa.array([k.tobytes() for k in found], pa.binary()))
                # the signature, and half of each key: enough to see which keys two texts share
                cols.append(pa.array([signature(g[1]).tobytes() + k.astype(np.uint32).tobytes() for g, k in zip(got, found, strict=True)], pa.binary()))
                cols.append(pa.array([len(g[1]) for g in got], pa.int32()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *_lane_names(plan), *_BAND_COLUMNS[: 4 * bool(plan.bands)]])

    schema = ", ".join(["doc_id long", *(f"{f} long" for f in _lane_names(plan)), *["digest long", "bands binary", "marks binary", "size int"][: 4 * bool(plan.bands)]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as the pairs (a, b), as pairs of a node and the least node of its group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        m = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y, root[x], root[y]):
            np.minimum.at(new, end, m)
        new = new[new]
        if (new == root).all():
            break
        root = new
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]


def linked(cell: np.ndarray, node: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows that share a cell and differ in radius bits or fewer, a spanning forest of each cell.

    Rows of a cell stand next to each other.
    """
    a, b = _near_pairs(cell, lanes, radius)
    return _forest(node[a], node[b]) if len(a) else (node[:0], node[:0])


def _near_pairs(cell: np.ndarray, lanes: np.ndarray, radius: int, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs within a cell and the radius for which keep(a, b) holds; looked at one distance of rows at a time."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    end = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(end > np.arange(len(cell)) + 1)
    a, b, d = [at[:0]], [at[:0]], 1
    while len(at):
        far = np.zeros(len(at), np.int64)
        for i in range(lanes.shape[1]):
            far += np.bitwise_count(lanes[at, i] ^ lanes[at + d, i])
        hit = at[far <= radius]
        if keep is not None and len(hit):
            hit = hit[keep(hit, hit + d)]
        a.append(hit)
        b.append(hit + d)
        d += 1
        at = at[end[at] > at + d]
    return np.concatenate(a), np.concatenate(b)


def likely_pairs(cell: np.ndarray, band: np.ndarray, node: np.ndarray, lanes: np.ndarray, bands: np.ndarray, marks: np.ndarray, size: np.ndarray, plan: Plan, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of a cell that may resemble as the plan asks.

    Each pair is looked at in the first band that the two share only. Without group: a spanning forest of those whose
    estimate reaches the similarity, and each row's most alike. With group: all between different groups.
    """
    estimate: list[np.ndarray] = []

    def keep(a, b):
        ok = np.ones(len(a), bool) if group is None else group[a] != group[b]
        ok[ok] = np.argmax(bands[a[ok]] == bands[b[ok]], axis=1) == band[a[ok]]
        r, may = likely(marks[a[ok]], marks[b[ok]], size[a[ok]], size[b[ok]], plan.similarity)
        estimate.append(r[may])
        ok[ok] = may
        return ok

    a, b = _near_pairs(cell, lanes, plan.radius, keep)
    if group is not None or not len(a):
        return node[a], node[b]
    r = np.concatenate(estimate)
    sure = r >= plan.similarity
    one, other = _forest(node[a[sure]], node[b[sure]]) if sure.any() else (node[:0], node[:0])
    ends, mates, like = np.r_[a, b], np.r_[b, a], np.r_[r, r]
    order = np.lexsort((node[mates], -like, ends))
    best = order[np.r_[True, ends[order][1:] != ends[order][:-1]]]
    return np.concatenate([one, node[ends[best]]]), np.concatenate([other, node[mates[best]]])


def links(nodes: DataFrame, plan: Plan = EXACT, cell_rows: int = CELL, group: str | None = None, used: list | None = None) -> DataFrame:
    """(a, b): edges that connect the same nodes as all pairs of fingerprints within the radius that share a key.

    nodes: node long, f0..; with a wide plan bands, marks, size too; one row per distinct fingerprint. All rows of
    a cell are compared, but of each cell only a spanning forest leaves the task. With a wide plan only pairs that may
    resemble enough leave it (see likely_pairs). A key with more than cell_rows rows is split into chunks, and each two
    chunks meet in a cell of their own, so no task gets a whole hot key and no pair is left out. With group (a column
    of nodes), every likely pair between different groups leaves, a < b. used: gets the tables that the plan reads.
    """
    spark, names = nodes.sparkSession, _lane_names(plan)
    wide_plan = bool(plan.bands)

    def make(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                cols = [part.column(i).to_numpy() for i in range(1 + len(names))]
                if wide_plan:
                    k = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in part.column(1 + len(names))])
                    r = np.repeat(np.arange(part.num_rows), plan.bands)
                    n = np.tile(np.arange(plan.bands, dtype=np.int32), part.num_rows)
                else:
                    r, k = keys(np.stack([c.view(np.uint64) for c in cols[1:]], axis=1), plan)
                    n = np.zeros(len(k), np.int32)
                # with a wide plan the rest is joined to the few rows that share a key
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), *(pa.array(c[r]) for c in cols[: 1 if wide_plan else None])], names=["key", "band", "node", *([] if wide_plan else names)])

    def compare(batches):
        import pyarrow as pa

        def found(cols):
            cell = np.cumsum(np.r_[0, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)])
            lanes = np.stack([c.view(np.uint64) for c in cols[5 : 5 + plan.lanes]], axis=1)
            if wide_plan:
                marks, size = cols[5 + plan.lanes : 7 + plan.lanes]
                marks = np.frombuffer(b"".join(marks), np.uint8).reshape(len(cell), BINS + 4 * plan.bands)
                bands, marks = np.ascontiguousarray(marks[:, BINS:]).view(np.uint32), marks[:, :BINS]
                a, b = likely_pairs(cell, cols[3], cols[4], lanes, bands, marks, size, plan, cols[-1] if group else None)
                a, b = np.minimum(a, b), np.maximum(a, b)
            else:
                a, b = linked(cell, cols[4], lanes, plan.radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, most = None, 20_000 if wide_plan else 200_000
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(held[0]) >= most:
                same = np.all([c == c[-1] for c in held[:3]], axis=0)
                last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if last:
                    yield found([c[:last] for c in held])
                    held = [c[last:] for c in held]
        if held is not None and len(held[0]):
            yield found(held)

    lane_types = "".join(f", {f} long" for f in ([] if wide_plan else names))
    keyed = nodes.select("node", *names, *["bands"] * wide_plan).mapInArrow(make, f"key long, band int, node long{lane_types}")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks")
    # of a wide plan's keys most are one text's alone; only shared ones go on
    hot = written(counts.where(F.col("n") > (1 if wide_plan else cell_rows)).select("key", F.when(F.col("n") > cell_rows, chunks).otherwise(F.lit(1)).alias("chunks")), "shared-keys")
    if used is not None:
        used.append(hot)
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(F.col("c"), j).alias("lo"), F.greatest(F.col("c"), j).alias("hi")))
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    extra = [*names, *([*_BAND_COLUMNS[2:], *([group] if group else [])] if wide_plan else [])]
    dealt = keyed.join(hot, "key", "inner" if wide_plan else "left").withColumn("c", chunk)
    if wide_plan:
        dealt = dealt.join(nodes.select("node", *extra), "node")
    dealt = dealt.select("key", F.explode(F.when(F.coalesce("chunks", F.lit(1)) == 1, one).otherwise(meet)).alias("cell"), "band", "node", *extra).select("key", "cell.lo", "cell.hi", "band", "node", *extra)
    ordered = dealt.repartition(shuffle_partitions(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def resembling(pairs: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Those of pairs (a, b: values of doc_id) whose texts' shingle sets have an exact resemblance of plan.similarity or more."""

    def sets(batches):
        import pyarrow as pa

        for b in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            got = [np.unique(shingle_hashes(t.as_py() or "", plan.words)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["node", "hashes"])

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= plan.similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ends, "doc_id", "left_semi")
    hashes = written(texts.mapInArrow(sets, "node long, hashes binary").distinct(), "shingles")
    left, right = hashes.toDF("a", "x"), hashes.toDF("b", "y")
    out = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct())
    discard(hashes)
    return out


def verified_links(nodes: DataFrame, docs: DataFrame, plan: Plan, cell_rows: int = CELL) -> DataFrame:
    """(a, b): edges that connect the same nodes as all pairs that share a key, are within the radius and resemble exactly.

    First the few pairs of links() are looked at: those that most likely resemble. Then every likely pair whose ends
    these did not yet connect is, so a large group of copies costs about as many pairs as it has rows, and yet no pair
    that matters is left out.
    """
    used: list[DataFrame] = []
    first = cut(links(nodes, plan, cell_rows, None, used))
    good = resembling(first, docs, plan)
    group = components(good).withColumnRenamed("component", "group")
    named = nodes.join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    rest = cut(links(named, plan, cell_rows, "group", used).join(first, ["a", "b"], "left_anti"))
    discard(*used)
    return good.union(resembling(rest, docs, plan))


def near_components(docs: DataFrame, plan: Plan = EXACT, cell_rows: int | None = None, used: list | None = None) -> DataFrame:
    """doc_id, f0.., component_id: the smallest doc_id reachable over links, itself included.

    Texts that are null, empty or without a word have fingerprint zero, linked like any other. Rows with equal doc_id
    are kept, each with its own text's fingerprint. A row with a null doc_id links other rows as any row does and takes
    the smallest doc_id of its component, null where no row of it has one; with a wide plan it takes only that of equal
    shingle sets. Other columns are ignored, whatever their names. With a wide plan equal means
    equal shingle sets, and every link has the exact resemblance that the plan asks for. used: gets the tables that the
    result's plan reads.
    """
    cell_rows = cell_rows or (WIDE_CELL if plan.bands else CELL)
    lanes = _lane_names(plan)
    names = [*lanes, *["digest"] * bool(plan.bands)]
    prints = written(fingerprints(docs, plan), "fingerprints")
    extra = [F.first(c).alias(c) for c in _BAND_COLUMNS[1:]] if plan.bands else []
    nodes = written(prints.groupBy(*names).agg(F.min("doc_id").alias("node"), *extra), "nodes")
    if used is not None:
        used += [prints, nodes]
    if not plan.bands:
        return prints.select("doc_id", *names).join(_least_ids(nodes, lambda named: components(links(named, plan, cell_rows))), names).select("doc_id", *lanes, "component_id")
    some = nodes.where("node is not null")
    found = components(verified_links(some, docs, plan, cell_rows))
    groups = nodes.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    return prints.select("doc_id", *names).join(groups, names).select("doc_id", *lanes, "component_id")


def _least_ids(nodes: DataFrame, linked) -> DataFrame:
    """Fingerprints (nodes without node) with component_id: the least node reached; nodes without an id link others all the same.

    linked: components of named nodes. Nodes without an id get numbers above all ids, or below them where ids reach
    the upper end of their type.
    """
    names = [c for c in nodes.columns if c != "node"]
    seen = nodes.agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count_if(F.col("node").isNull()).alias("without")).first()
    if seen["without"]:
        room = 1 << 60
        base = 0 if seen["high"] is None else seen["high"] + 1 if seen["high"] < (1 << 63) - room else seen["low"] - room
        nodes = written(nodes.withColumns({"real": F.col("node"), "node": F.coalesce("node", F.monotonically_increasing_id() + F.lit(base))}), "named-nodes")
    of = nodes.join(linked(nodes.select(*names, "node")), "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    if not seen["without"]:
        return of.select(*names, "component_id")
    least = of.groupBy("component_id").agg(F.min("real").alias("least"))
    return of.select(*names, "component_id").join(least, "component_id").select(*names, F.col("least").alias("component_id"))


def simhash_documents(docs: DataFrame, cell_rows: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id with the exact plan; cases as in near_components."""
    got = near_components(docs, EXACT, cell_rows)
    return got.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """docs without all but the first (smallest doc_id) document of each group of near copies; all columns are kept.

    Rows with a null doc_id are kept. Of rows with equal doc_id that is its group's smallest, all are kept.
    """
    used: list[DataFrame] = []
    got = near_components(docs, plan or wide(), used=used)
    gone = written(got.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    discard(*used)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
