"""Substring dedup by hashing of lines, of the sentences of lines, of both, or of passages.

A text is cut into units that tile it: runs of text each with the marks that end it (a line by its line ends; a
sentence also by full stops and the like; a passage by the marks of other scripts too, and a unit of more than LONG
words once more behind each word whose hash says so). A unit's digest is the hash of its normalised words (lower case,
single spaces). Of all units of the corpus with one digest the first in order of (doc_id, position) is the original, the
others are repeats, and their places in the original text are kept.

Short units repeat by chance in any prose. So repeats are cut where they stand next to each other in runs of RUN words
or more: a run is a passage that was copied, while a single short sentence that also stands elsewhere stays. Units
without a word (white space, marks) neither end a run nor are cut. A copied passage is found but for the pieces at its
two ends that share a unit with other text.

With both, every line that repeats an earlier line goes, however short it is, as one cut; of the other lines go the
runs of repeated sentences. Lines repeat lines only and sentences repeat sentences only.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, discard, written

#: Least words of a run of repeats that is cut.
RUN = 16
LONG, PIECE = 24, 8  # words of a unit that is split; one word in so many ends a piece
#: Ends of units; the same patterns hold in SQL.
UNITS = {"line": "[^\n]+\n*|\n+", "sentence": "[^.!?\n]+[.!?\n]*|[.!?\n]+", "passage": "[^.!?\n。！？｡．؟۔।…]+[.!?\n。！？｡．؟۔।…]*|[.!?\n。！？｡．؟۔।…]+"}
#: The sentences of lines when both are units: each lies in one line.
UNITS["inner"] = "[^.!?\n]+[.!?]*\n*|[.!?]+\n*|\n+"
#: Where a null doc_id ranks.
LAST_ID = (1 << 63) - 1
_RUN = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of scripts without spaces between words (Thai to Khmer, kana, Han); two count as a word of a passage.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")


def _pieces(unit: str, start: int):
    """(start, end, words) of the pieces that tile a long unit; their ends depend on the words there only."""
    at, words = 0, []
    for m in _RUN.finditer(unit):
        words.append(m.group().encode("utf-8", "surrogatepass"))
        if xxhash.xxh3_64_intdigest(words[-1]) % PIECE == 0:
            yield start + at, start + m.end(), words
            at, words = m.end(), []
    if words:
        yield start + at, start + len(unit), words


def units(text: str, unit: str):
    """(start, end, number of words, normalised words) of each unit that has a word."""
    low = text.lower()
    same = len(low) == len(text)
    for m in re.finditer(UNITS[unit], text):
        t = low[m.start() : m.end()] if same else m.group().lower()
        w = t.encode("utf-8", "surrogatepass").split()
        if unit != "passage":
            if w:
                yield m.start(), m.end(), len(w), w
            continue
        for start, end, ws in _pieces(t, m.start()) if len(w) > LONG and len(t) == m.end() - m.start() else [(m.start(), m.end(), w)] * bool(w):
            n = len(ws)
            if not t.isascii():
                n = max(n, len(_UNSPACED.findall(text, start, end)) // 2)
            yield start, end, n, ws


_PLACE = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
_OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.ArrayType(_PLACE))])


def _runs(text: str, at: np.ndarray, unit: str, least: int) -> list[tuple[int, int]]:
    """Places of the units with these ascending numbers that stand in runs of so many words."""
    if not len(at):
        return []
    start, end, n = np.array([u[:3] for u in units(text, unit)], np.int64)[at].T
    of = np.cumsum(np.r_[0, at[1:] != at[:-1] + 1])
    gone = np.bincount(of, n)[of] >= least
    return list(zip(start[gone].tolist(), end[gone].tolist(), strict=True))


def _lines_and_runs(text: str, at: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Places of the repeated lines, numbered -1, -2 and so on, and of the runs of sentences in other lines."""
    lines = [u[:2] for u in units(text, "line")]
    whole = [lines[-1 - i] for i in at[at < 0][::-1]]
    firsts = np.array([a for a, _ in whole], np.int64)
    rest = _runs(text, at[at >= 0], "inner", least)
    in_line = np.searchsorted(firsts, [a for a, _ in rest], "right") - 1
    return sorted([*whole, *[r for r, i in zip(rest, in_line, strict=True) if i < 0 or r[0] >= whole[i][1]]])


@F.pandas_udf(_OUT)
def _cut_out(text: pd.Series, repeats: pd.Series, unit: pd.Series, run: pd.Series) -> pd.DataFrame:
    """Texts without their repeated lines and runs of repeats; repeats: the ascending numbers of units that repeat earlier ones."""
    texts, places = [], []
    for t, at, kind, least in zip(text, repeats, unit, run, strict=True):
        cuts = []
        if t is not None and at is not None and len(at):
            cuts = _lines_and_runs(t, at, least) if kind == "both" else _runs(t, at, kind, least)
        kept, done = [], 0
        for start, end in cuts:
            kept.append(t[done:start])
            done = end
        texts.append(t if t is None else "".join([*kept, t[done:]]))
        places.append([{"first": a, "last": b} for a, b in cuts])
    return pd.DataFrame({"text": pd.Series(texts, dtype=object), "removed": pd.Series(places, dtype=object)})


def repeated_units(docs: DataFrame, unit: str = "sentence") -> DataFrame:
    """(id, t, at): all units that repeat an earlier one; id and t tell the document, at is the unit's number in it.

    Units without a word have no number. With both, lines are numbered -1, -2 and so on. Earlier: smaller doc_id (null: after all others), then smaller hash of the
    text, then smaller number. Repeats of one unit are counted on the map side before they meet, so a unit of very many
    documents costs each task one row; the original is found by grouping, the rest by a join.
    """

    def run(batches):
        import pyarrow as pa

        h = xxhash.xxh3_128_digest
        for b in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            texts = [text or "" for text in b.column(2).to_pylist()]
            got = [[h(b" ".join(w)) for _, _, _, w in units(text, "inner" if unit == "both" else unit)] for text in texts]
            rows = np.array([len(x) for x in got], np.int64)
            at = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
            of = np.repeat(np.arange(len(rows)), rows)
            if unit == "both":
                lines = [[h(b" ".join(w), 1) for _, _, _, w in units(text, "line")] for text in texts]
                rows = np.array([len(x) for x in lines], np.int64)
                at = np.r_[at, np.repeat(np.cumsum(rows) - rows, rows) - np.arange(rows.sum()) - 1]
                of = np.r_[of, np.repeat(np.arange(len(rows)), rows)]
                got += lines
            of = pa.array(of)
            d = np.frombuffer(b"".join(x for ds in got for x in ds), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(at.astype(np.int32)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=["id", "t", "at", "d1", "d2"])

    found = docs.select(*_key(docs), "text").mapInArrow(run, "id long, t long, at int, d1 long, d2 long")
    found = written(found, "units")
    order = F.struct(F.coalesce("id", F.lit(LAST_ID)).alias("id"), "t", F.abs("at").alias("at"))
    groups = found.groupBy("d1", "d2").agg(F.min(order).alias("original"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    out = written(found.join(groups, ["d1", "d2"]).where(order != F.col("original")).select("id", "t", "at"), "repeats")
    discard(found)
    return out


def _key(docs: DataFrame):
    """What tells a document: its id and, where any id occurs twice, a hash of its text (else 0, which takes no room)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    twice = not ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return F.col("doc_id").cast("long").alias("id"), (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("t")


def dedup_units(docs: DataFrame, unit: str = "sentence", run: int = RUN, keep_empty: bool = True) -> DataFrame:
    """docs with runs of repeats cut from text, and removed: array of (first, last), the places of the cut units.

    All columns are kept; one more, removed, is added (a column of that name is replaced). Rows that agree in doc_id
    and text are one document: they stay equal. Rows with equal doc_id and unlike texts are documents of their own, as
    are rows with a null doc_id, which rank last. Null texts stay null, empty ones empty; an empty table gives no rows.
    run=1 cuts every repeat; unit="both" cuts every repeated line and runs inside other lines. keep_empty=False drops documents of which nothing but white space is left.
    """
    found = repeated_units(docs, unit).groupBy(F.col("id").alias("__id"), F.col("t").alias("__t")).agg(F.array_sort(F.collect_list("at")).alias("__at"))
    columns = [c for c in docs.columns if c != "removed"]
    i, t = _key(docs)
    both = docs.select(*columns).join(found, i.eqNullSafe(F.col("__id")) & (t == F.col("__t")), "left")
    both = both.withColumn("__out", _cut_out("text", "__at", F.lit(unit), F.lit(run)))
    out = both.select(*[F.col("__out.text").alias(c) if c == "text" else F.col(c) for c in columns], F.col("__out.removed").alias("removed"))
    return out if keep_empty else out.where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
