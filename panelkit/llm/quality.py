"""Quality of documents by histogram gradient-boosted trees over document statistics.

Statistics: sizes, shares of kinds of characters, how words begin and end, lengths and repetition of words, word triples
and lines. They are made once for every document from its whole text and written; learning and scoring read those rows.

Learning: values are put into quantile bins; each level of a tree is chosen from sums of gradients by (node, statistic,
bin). Trees are complete, so a forest is three arrays (statistic, threshold, leaf value) and scoring walks all trees of
a batch at once, level by level, in numpy. A node that is not split sends every row left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, written

#: Bound of the labelled sample: documents of each label, by hash of their ids. All that is learned comes from these.
SAMPLE = 6000
#: Trees, their depth, the learning rate, bins of a statistic, least documents and ridge of a leaf, statistics that a tree may use.
TREES, DEPTH, RATE, BINS, LEAST, RIDGE, USED = 120, 3, 0.1, 64, 20, 1.0, 0.4
#: Bytes of a text that are looked at together; repetition is counted within such pieces.
PIECE = 1 << 20

#: Kinds of bytes: other, lower, upper, digit, blank, end of line, sentence marks, brackets and quotes, non-ASCII.
KINDS = ("symbol", "lower", "upper", "digit", "blank", "line", "mark", "bracket", "wide")
_GROUPS = {1: b"abcdefghijklmnopqrstuvwxyz", 2: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3: b"0123456789", 4: b" \t\x0b\x0c\r", 5: b"\n", 6: b".,;:!?", 7: b"()[]'\"-", 8: bytes(range(128, 256))}
KIND = np.zeros(256, np.int64)
for _k, _bytes in _GROUPS.items():
    KIND[list(_bytes)] = _k
_K = len(KINDS)

STATISTICS = (
    "log_bytes", "log_words", *(f"share_{k}" for k in KINDS), "entropy", "word_mean", "word_sd", "distinct_words", "top_word", "distinct_triples", *(f"begins_{k}" for k in KINDS if k not in ("blank", "line")),
    *(f"ends_{k}" for k in KINDS if k not in ("blank", "line")), "doubled_marks", "repeated_lines", "words_a_line", "words_a_mark",
)
_EDGES = [i for i, k in enumerate(KINDS) if k not in ("blank", "line")]


def _piece(text: bytes) -> np.ndarray:
    """Sums over one piece: bytes by value, words that begin and end with each kind, then single numbers."""
    a = np.frombuffer(text, np.uint8)
    kinds = KIND[a]
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = (kinds != 4) & (kinds != 5)
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    size = (ends - starts).astype(float)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in text.split()), np.int64)
    triples = len(np.unique((ids[:-2] * len(numbers) + ids[1:-1]) * len(numbers) + ids[2:])) if len(ids) > 2 else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    doubled = int(((a[1:] == a[:-1]) & np.isin(kinds[1:], (0, 6))).sum())
    top = int(np.bincount(ids).max()) if len(ids) else 0
    rest = [len(size), size.sum(), (size**2).sum(), len(numbers), top, triples, max(0, len(ids) - 2), doubled, len(lines), len(set(lines))]
    return np.concatenate([np.bincount(a, minlength=256), np.bincount(kinds[starts], minlength=_K), np.bincount(kinds[ends - 1], minlength=_K), rest])


def statistics(text: bytes) -> np.ndarray:
    """STATISTICS of a whole text; all 0 (entropy, shares, means of nothing) for an empty one.

    Long texts are summed piece by piece, cut at a blank.
    """
    total, at = np.zeros(256 + 2 * _K + 10), 0
    while at < len(text):
        cut = text.find(b" ", at + PIECE)
        cut = len(text) if cut < 0 else cut
        total += _piece(text[at:cut] if at or cut < len(text) else text)
        at = cut
    values, begins, ends = total[:256], total[256 : 256 + _K], total[256 + _K : 256 + 2 * _K]
    words, letters, squares, distinct, top, triples, places, doubled, lines, unlike = total[256 + 2 * _K :]
    n, w = max(1.0, values.sum()), max(1.0, words)
    kinds = np.bincount(KIND, values, _K)
    p = values[values > 0] / n
    mean = letters / w
    return np.r_[
        np.log1p(values.sum()), np.log1p(words), kinds / n, -(p * np.log2(p)).sum(), mean, np.sqrt(max(0.0, squares / w - mean**2)), distinct / w, top / w, triples / max(1.0, places), begins[_EDGES] / w,
        ends[_EDGES] / w, doubled / n, (lines - unlike) / max(1.0, lines), words / max(1.0, lines), words / max(1.0, kinds[6]),
    ]


@dataclass
class Forest:
    """Complete trees as arrays: statistic and threshold of each inner node, value of each leaf, and the start value."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, depth = len(self.value), self.value.shape[1].bit_length() - 1 if len(self.value) else 0
        at, tree, row = np.zeros((len(x), trees), np.int64), np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.start + self.value[tree, at - (2**depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosting on the logistic loss, each tree over a drawn part of the statistics; rows in a fixed order give the same forest each time."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(k)]
    bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    limit = np.full((k, BINS), np.inf)
    for f, e in enumerate(edges):
        limit[f, : len(e)] = e
    place = bins + np.arange(k) * BINS
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    raw, forest = np.full(n, start), Forest(np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), start)
    draw, used = np.random.default_rng(0), max(1, round(USED * k))
    for t in range(trees):
        barred = np.setdiff1d(np.arange(k), draw.permutation(k)[:used])
        p = 1 / (1 + np.exp(-raw))
        g, h, at = weight * (y - p), weight * p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            key = ((at - first)[:, None] * (k * BINS) + place).ravel()
            sums = [np.bincount(key, None if v is None else np.repeat(v, k), nodes * k * BINS).reshape(nodes, k, BINS).cumsum(axis=2) for v in (g, h, None)]
            whole = [s[:, :1, -1:] for s in sums]
            gl, hl, nl = sums
            gr, hr, nr = (a - b for a, b in zip(whole, sums, strict=True))
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(nl < LEAST) | (nr < LEAST)] = -1
            gain[:, barred] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            forest.feature[t, first : first + nodes] = np.where(good, f, 0)
            forest.threshold[t, first : first + nodes] = np.where(good, limit[f, b], np.inf)
            own = at - first
            at = 2 * at + 1 + (good[own] & (bins[np.arange(n), f[own]] > b[own]))
        leaf = at - (2**depth - 1)
        forest.value[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + RIDGE)
        raw += forest.value[t][leaf]
    return forest


def document_statistics(docs: DataFrame, fold: int, folds: int) -> DataFrame:
    """doc_id, held_out, x: the statistics of each row's whole text, null as empty."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = [pa.scalar(statistics(t.as_buffer().to_pybytes()).astype(np.float32).tolist(), pa.list_(pa.float32())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "held_out", "x"])

    held = F.coalesce(crc_mod("doc_id", folds) == fold, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, x array<float>")


def learn(table: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 2, folds: int = 4) -> Forest:
    """A forest from document_statistics of labelled documents that are not held out (crc32 of doc_id mod folds is fold).

    Bounded: at most SAMPLE documents of each label, those with the least hashes of their ids; each stands for as many
    as there are to one of the sample. Of labels that disagree on a document the least counts. Without labels of both
    kinds every score is near the share of label 1 (0 without any label).
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != fold)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    empty = Forest(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)), 30.0 if n.get(1) else -30.0)
    if not n.get(0) or not n.get(1):
        return empty
    some = [known.where(F.col("label") == k).withColumn("h", F.xxhash64("doc_id", F.lit(label))).orderBy("h", "doc_id").limit(SAMPLE) for k in (0, 1)]
    picked = sorted((r["doc_id"], r["label"]) for s in some for r in s.select("doc_id", "label").collect())
    ids = F.broadcast(table.sparkSession.createDataFrame(picked, "doc_id long, label int"))  # 2 * SAMPLE rows
    # one row a document: of rows that share an id, the one with the least statistics
    rows = table.select(F.col("doc_id").cast("long").alias("doc_id"), "x").join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()
    if not rows:
        return empty
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], float)
    return fit(np.array([r["x"] for r in rows]), y, np.where(y == 1, max(1.0, n[1] / SAMPLE), max(1.0, n[0] / SAMPLE)))


def score_quality(docs: DataFrame, labels: DataFrame, fold: int = 2, folds: int = 4, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, from the whole text alone.

    Null and empty texts have the same statistics, so the same score; so have equal texts. A null doc_id counts as not
    held out and has no label. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    table = written(document_statistics(docs, fold, folds), "statistics")
    forest = table.sparkSession.sparkContext.broadcast(learn(table, labels, "quality", fold, folds))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                s = forest.value.score(b.column(2).flatten().to_numpy().reshape(b.num_rows, -1).astype(float))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return table.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
