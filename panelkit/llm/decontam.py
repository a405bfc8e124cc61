"""Benchmark decontamination by greedy string tiling.

Texts are compared as word sequences (letters and digits, lower case). Seeds are the runs of TILE words, by a rolling
hash. Documents' and items' seeds are joined in Spark; a pair of a document and an item goes on if its shared seeds can
cover enough of the item at all. In such a pair the longest run of words that neither side has marked yet is marked as
a tile, again and again until none of TILE words is left; matches of each length are found by running Karp-Rabin
hashing. The pair's coverage is the share of the item's words under tiles, so an item whose sentences were put in
another order is covered as well as a straight copy.

An item of fewer than TILE words stands in a document if one of its lines is that item and nothing else.

Documents are read once for their seeds, however large the benchmark is: a Bloom filter of the items' seeds, of at
most FILTER_BITS bits, is all that is sent to the workers, and only seeds that pass it leave a task.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Least words of a tile; least share of an item's words under tiles that makes a document contaminated.
TILE, COVERAGE = 5, 0.5
#: Bits of the filter for each seed, most bits of it (8 MB), and bits of the pieces in which tasks report theirs.
SEED_BITS, FILTER_BITS, PIECE_BITS = 32, 1 << 26, 1 << 15

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of size numbers (mod 2^64)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _BASE + (ids[i : i + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, words) of the greedy tiles, the longest first; ties by place in doc, then in item.

    doc and item are word numbers; a negative number matches nothing. Only hashes of windows are held, never pairs of
    places, so long texts that repeat themselves take no more room than others.
    """
    open_doc, open_item = doc >= 0, item >= 0
    out: list[tuple[int, int, int]] = []

    def windows(ids: np.ndarray, is_open: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the windows without a marked word, their hashes)."""
        h = rolling(ids, size)
        closed = np.cumsum(np.r_[0, ~is_open])
        at = np.flatnonzero(closed[size:] == closed[: len(closed) - size]) if len(h) else np.empty(0, np.int64)
        return at, h[at]

    def shared(size: int) -> bool:
        return bool(np.isin(windows(item, open_item, size)[1], windows(doc, open_doc, size)[1]).any())

    most = min(len(doc), len(item))
    while most >= least and shared(least):
        lo, hi = least, most  # the longest length at which a window is shared
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if shared(mid) else (lo, mid - 1)
        size = most = lo
        at, h = windows(item, open_item, size)
        table: dict[int, list[int]] = {}
        for j, x in zip(at.tolist(), h.tolist(), strict=True):
            table.setdefault(x, []).append(j)
        at, h = windows(doc, open_doc, size)
        hit = np.isin(h, np.fromiter(table, np.uint64, len(table)))
        marked = False
        for i, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
            if not open_doc[i : i + size].all():
                continue
            for j in table[x]:
                if open_item[j : j + size].all() and (doc[i : i + size] == item[j : j + size]).all():
                    open_doc[i : i + size] = open_item[j : j + size] = False
                    out.append((i, j, size))
                    marked = True
                    break
        if not marked:  # equal hashes of unlike windows
            most -= 1
    return out


class _WordHash(dict):
    """64-bit hash of a word; starts anew at a fixed size, so memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hash = _WordHash()


def seeds(text: str, least: int) -> np.ndarray:
    """Hashes of all runs of so many words, and of each line of fewer."""
    lines = [_WORD.findall(x) for x in text.lower().split("\n")]
    h = np.fromiter((_hash[w] for ws in lines for w in ws), np.uint64)
    short = [(at, len(ws)) for at, ws in zip(accumulate(map(len, lines), initial=0), lines) if 0 < len(ws) < least]
    whole = [rolling(h[at : at + n], n)[0] ^ np.uint64(n) for at, n in short]
    return np.concatenate([rolling(h, least), np.array(whole, np.uint64)])


def item_seeds(text: str, least: int) -> np.ndarray:
    """As seeds(); an item of fewer words is one seed, whatever its lines."""
    ws = words(text)
    return seeds(" ".join(ws), least) if ws else np.empty(0, np.uint64)


def _key(id_column: str):
    """What tells a row: its id and a hash of its text."""
    return F.col(id_column).alias("id"), F.xxhash64("text").alias("t")


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of size bits (a power of two)."""
    return (h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def seed_filter(items: DataFrame) -> np.ndarray:
    """A Bloom filter of the column h: tasks report the pieces that they set, which are put together by piece."""
    n = items.count()
    size = max(PIECE_BITS, min(FILTER_BITS, 1 << max(1, SEED_BITS * n - 1).bit_length()))

    def mark(batches):
        import pyarrow as pa

        own = np.zeros(size, bool)
        for b in batches:
            for at in _bits(b.column(0).to_numpy().view(np.uint64), size):
                own[at] = True
        pieces = own.reshape(-1, PIECE_BITS)
        some = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([np.packbits(pieces[i]).tobytes() for i in some], pa.binary())], names=["piece", "bits"])

    def put(pdf):
        import pandas as pd

        all_bits = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in pdf["bits"]]), axis=0)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "bits": [all_bits.tobytes()]})

    out = np.zeros((size // PIECE_BITS, PIECE_BITS), bool)
    for r in items.select("h").mapInArrow(mark, "piece int, bits binary").groupBy("piece").applyInPandas(put, "piece int, bits binary").collect():  # FILTER_BITS at most
        out[r["piece"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return out.ravel()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = TILE) -> DataFrame:
    """doc_id, item_id, coverage, tiles: every pair of a document and an item with at least this coverage.

    Null or empty texts and items without a word match nothing. Rows with equal ids and unlike texts are rows of their
    own; a repeated row gives its pairs again. Null ids are ids like any other. An empty table on either side gives no
    rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    names = ["id", "t", "h", "n", "words"]

    def of_items(batches):
        import pyarrow as pa

        for b in batches:
            rows: list[tuple[int, int, int, int]] = []
            for i, text in enumerate(b.column(2).to_pylist()):
                h, n = np.unique(item_seeds(text, least), return_counts=True)
                size = len(words(text))
                rows += [(i, *x, size) for x in zip(h.view(np.int64).tolist(), n.tolist(), strict=True)]
            i, h, n, size = zip(*rows, strict=True) if rows else ((), (), (), ())
            take = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(size, pa.int32())], names=names)

    items = benchmark.where("text is not null").select(*_key("item_id"), "text").distinct()
    items = written(items.mapInArrow(of_items, f"id {item_kind}, t long, h long, n int, words int"), "item-seeds")
    bloom = seed_filter(items)
    shared = spark.sparkContext.broadcast(np.packbits(bloom))  # FILTER_BITS at most

    def of_docs(batches):
        import pyarrow as pa

        bits = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                got = [seeds(t, least) for t in part.column(2).to_pylist()]
                owner = np.repeat(np.arange(len(got)), [len(x) for x in got])
                h = np.concatenate(got)
                one, two = _bits(h, len(bits))
                near = np.flatnonzero(bits[one] & bits[two])
                owner, h = owner[near], h[near].view(np.int64)
                order = np.lexsort((h, owner))  # each seed of a document once
                owner, h = owner[order], h[order]
                new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])][: len(h)]
                take = pa.array(owner[new])
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(h[new])], names=names[:3])

    found = docs.where("text is not null").select(*_key("doc_id"), "text").mapInArrow(of_docs, f"id {doc_kind}, t long, h long")
    side = items.withColumnsRenamed({"id": "item", "t": "item_t"})
    pairs = found.join(side, "h").groupBy("id", "t", "item", "item_t").agg(F.sum("n").alias("n"), F.first("words").alias("words"))
    # a shared seed covers at most its own words of the item, each time that the item has it
    pairs = pairs.where((F.col("n") * least >= F.lit(coverage) * F.col("words")) | (F.col("words") < least)).select("id", "t", "item", "item_t")
    pairs = written(pairs, "seed-pairs")

    def tile(batches):
        import pyarrow as pa

        for b in batches:
            keep, share, count = [], [], []
            for i, (text, item) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                own = words(item)
                number: dict[str, int] = {}
                want = np.array([number.setdefault(w, len(number)) for w in own], np.int64)
                if len(own) < least:
                    covered, n = len(own) * any(words(x) == own for x in text.split("\n")), 1
                else:
                    ws = words(text)
                    got = tiles(np.fromiter((number.get(w, -1) for w in ws), np.int64, len(ws)), want, least)
                    covered, n = sum(x for _, _, x in got), len(got)
                if covered and covered >= coverage * len(own):
                    keep.append(i)
                    share.append(covered / len(own))
                    count.append(n)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(share, pa.float64()), pa.array(count, pa.int32())], names=["doc_id", "item_id", "coverage", "tiles"])

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    texts = docs.where("text is not null").select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("__t"))
    item_texts = benchmark.where("text is not null").select("item_id", F.col("text").alias("item_text"), F.xxhash64("text").alias("__it"))
    both = pairs.join(item_texts, same("item", "item_id") & (F.col("item_t") == F.col("__it")))
    both = texts.join(both.select("id", "t", "item_id", "item_text"), same("doc_id", "id") & (F.col("__t") == F.col("t")))
    return both.select("doc_id", "item_id", "text", "item_text").mapInArrow(tile, f"doc_id {doc_kind}, item_id {item_kind}, coverage double, tiles int")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = TILE) -> DataFrame:
    """docs without those that hold an item at this coverage; all columns are kept.

    A row goes with all rows of its doc_id; rows with a null doc_id stay. Null and empty texts stay. An empty table on
    either side drops nothing.
    """
    gone = contaminated(docs, benchmark, coverage, least).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
