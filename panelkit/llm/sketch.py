"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least distinct 48-bit hashes of a text's five-word shingles, ascending, as one string of 12 hex
digits each. Equal texts have equal sketches. Sketches of the parts of a set merge into the sketch of the whole. From
two of them come estimates of resemblance and containment, from one the count of distinct shingles; all three are
exact while a set has fewer than k shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RUNS, id_cuts, id_part, lower_words, shuffle_partitions

K, SHINGLE, DIGITS = 96, 5, 12
_SHIFT = np.uint64(64 - 4 * DIGITS)


class _WordHash(dict):
    """64-bit hash of a word; starts anew at a fixed size, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_hash = _WordHash()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that the least hashes are a fair sample."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash per shingle, repeats included; fewer words than size: one of the whole sequence; none: empty."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mixed(out)


def sketch(text: str, k: int = K) -> np.ndarray:
    h = shingle_hashes(text) >> _SHIFT
    if len(h) > 4 * k:
        least = np.unique(np.partition(h, 2 * k)[: 2 * k])
        if len(least) >= k:  # else many repeats: look at all
            return least[:k]
    return np.unique(h)[:k]


def encode(s: np.ndarray) -> str:
    return b"".join(b"%012x" % int(x) for x in s).decode()


def decode(s: str) -> np.ndarray:
    return np.array([int(s[i : i + DIGITS], 16) for i in range(0, len(s), DIGITS)], np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two parts."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's sketch that both hold; two empty sketches: 1."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean())


def distinct(s: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else (k - 1) over the k-th least hash as a share of the range."""
    return float(len(s)) if len(s) < k else (k - 1) * float(1 << (4 * DIGITS)) / float(int(s[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds; an empty a: 1."""
    if not len(a):
        return 1.0
    r, union = resemblance(a, b, k), distinct(merge(a, b, k), k)
    return min(1.0, r * union / distinct(a, k))


def merged_fingerprints(prints: DataFrame, by: str, fingerprint: str = "fingerprint") -> DataFrame:
    """by, fingerprint, distinct_shingles: the sketch of all texts of each group, from their own sketches.

    A task first merges what it holds of each group, so a group of any size comes together as one sketch a task. Null
    fingerprints count as empty; a null group is a group.
    """

    def run(batches):
        import pyarrow as pa

        held: dict = {}

        def out():
            keys, values = list(held), [encode(x) for x in held.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(values, pa.string())], names=[by, "part"])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = decode(s or "")
                held[k] = merge(held[k], x) if k in held else x
                if len(held) >= 20_000:
                    yield out()
        if held:
            yield out()

    def join(pdf):
        import pandas as pd

        whole = decode("")
        for s in pdf["part"]:
            whole = merge(whole, decode(s))
        return pd.DataFrame({by: pdf[by].iloc[:1], "fingerprint": [encode(whole)], "distinct_shingles": [distinct(whole)]})

    kind = dict(prints.dtypes)[by]
    parts = prints.select(by, F.col(fingerprint).alias("f")).mapInArrow(run, f"{by} {kind}, part string")
    return parts.groupBy(by).applyInPandas(join, f"{by} {kind}, fingerprint string, distinct_shingles double")


def _fingerprints(batches):
    """Streams rows in order of (part, copy, doc_id); the text of the next row in the part is the next document's."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("contained_in_next", pa.float64()), ("distinct_shingles", pa.float64())])

    def row(doc_id, text, own, after, after_sketch):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        es = own if edited == text else sketch(edited)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(own), encode(es), resemblance(own, es), resemblance(own, after_sketch), containment(own, after_sketch), distinct(own))

    held = None  # (part, copy, doc_id, text, sketch)
    for b in batches:
        out = []
        for part, copy, doc_id, text in (x for at in range(0, b.num_rows, 512) for x in zip(*(b.slice(at, 512).column(i).to_pylist() for i in range(4)), strict=True)):
            now = (part, copy, doc_id, text, sketch(text))
            if held and held[0] == part and not held[1]:
                out.append(row(held[2], held[3], held[4], text, now[4]))
            held = now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text replaces the last floor(n_chars/2) code points by the first as many of the next document in
    ascending doc_id (null ids first, equal ids by text; after the last comes the first, a lone document is its own
    next). Null texts count as empty; an empty text has an empty fingerprint, which is like (1.0) only an empty one.
    Other columns are ignored, whatever their names.

    The ids are cut into runs of about equal size, and the first document of a run is also sent to the run before, so
    each text is shuffled once (and one more per run) and every task sees its rows in order, with the next at hand.
    """
    parts = parts or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cuts = id_cuts(rows, RUNS * parts)
    lowest = rows.agg(F.min("doc_id").alias("m"), F.max(F.col("doc_id").isNull()).alias("n")).first()
    part = id_part(cuts)
    is_first = F.col("doc_id").isNull() if lowest["n"] else F.col("doc_id") == F.lit(lowest["m"])
    at = F.lit(len(cuts))
    opens = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    none = F.array().cast("array<struct<part:int,copy:int>>")
    to = F.concat(
        F.array(F.struct(part.cast("int").alias("part"), F.lit(0).alias("copy"))),
        F.when(F.coalesce(opens, F.lit(False)), F.array(F.struct((part - 1).cast("int").alias("part"), F.lit(1).alias("copy")))).otherwise(none),
        F.when(F.coalesce(is_first, F.lit(False)), F.array(F.struct(at.cast("int").alias("part"), F.lit(2).alias("copy")))).otherwise(none),
    )
    dealt = rows.select(F.explode(to).alias("to"), "doc_id", "text").select("to.part", "to.copy", "doc_id", "text")
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "copy", "doc_id", "text")
    return ordered.mapInArrow(
        _fingerprints,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_next double, distinct_shingles double",
    )
