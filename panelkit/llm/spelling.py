"""Spelling variant grouping: near words by a variable-length gram index, and the form that each word leads to.

Words are counted over whole texts. Two words are near if one insertion, deletion or replacement of a code point makes
one of the other. They are found through grams of 2 to 4 characters of the word between two marks:

- Dictionary: a gram is extended as long as it is frequent, so rare grams stay short and frequent ones grow. It is
  given by the frequent grams with their counts, of which there are at most 3 * MOST, whatever the vocabulary.
- Decomposition: at each place the longest gram, without those that lie inside an earlier one.
- Bound: an edit touches the grams around it, and others that now may be cut differently. The most it can touch, over
  all edits, is the word's bound. A marked word has at least 8 characters, twice the longest gram, so the first or the
  last gram always lies out of reach: near words share at least one gram, and one among the (bound + 1) rarest of each.
- Lists of these grams by place and length are joined, and each pair that meets is verified.

Cases: null texts hold no word, empty ones neither; a null doc_id reads as '' in the rule that damages words. Repeated
rows each count. Ties between forms go to the word that is first by code points. Texts of any length are read in
pieces. An empty table gives an empty result. Other columns of docs are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .divergence import document_terms

#: Code points and occurrences of a word at least; a form has so many times the occurrences; one run in so many is damaged.
SHORTEST, LEAST, TIMES, DAMAGED = 6, 5, 5, 199
#: Lengths of grams, and the marks at a word's ends (outside the alphabet of words).
GRAM_MIN, GRAM_MAX, MARKS = 2, 4, ("^", "$")
#: A gram is frequent above so many places, or above one in MOST of all places.
FREQUENT, MOST = 200, 50_000
#: Entries that a task holds before it gives them away.
HELD = 400_000

#: Runs of at least SHORTEST letters in UTF-8, A-Z lowered: the lead byte C3 is that of U+00C0 to U+00FF and no other.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % SHORTEST)


def document_words(doc_id: int | None, text: bytes) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of one text; a word may come more than once."""
    begun = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for token, n in document_terms(text).items():
        if len(token) < SHORTEST:
            continue
        for run in (token,) if token.isascii() else RUN.findall(token):
            h = zlib.crc32(run, begun)
            if h % DAMAGED:
                yield run, n
            elif len(letters := run.decode()) > SHORTEST:
                at = h % len(letters)
                yield (letters[:at] + letters[at + 1 :]).encode(), n


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held: Counter = Counter()

    def out() -> Iterator:
        words = list(held)
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array([held[w] for w in words[i : i + 50_000]], pa.int64())], names=["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for word, n in document_words(doc_id, text.as_buffer().to_pybytes()):
                held[word] += n
            if len(held) >= HELD:
                yield from out()
                held = Counter()
    yield from out()


def words(docs: DataFrame) -> DataFrame:
    """word, n: all words of the corpus with their occurrences."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    counts = rows.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST).select(F.col("word").cast("string").alias("word"), "n")


def frequent_grams(vocabulary: DataFrame) -> dict[str, int]:
    """The grams that stand at more places of the marked words than the threshold, with their numbers of places.

    The threshold is at least one in MOST of all places, so there are fewer than MOST grams of each length.
    """
    marked = F.concat(F.lit(MARKS[0]), "word", F.lit(MARKS[1]))
    places = vocabulary.agg(F.sum(F.length(marked))).first()[0] or 0  # one number
    grams = F.explode(F.flatten(F.transform(F.sequence(F.lit(GRAM_MIN), F.lit(GRAM_MAX)), lambda q: F.transform(F.sequence(F.lit(1), F.length("m") - q + 1), lambda p: F.substring(F.col("m"), p, q)))))
    counts = vocabulary.select(marked.alias("m")).select(grams.alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r["gram"]: r["n"] for r in counts.where(F.col("n") > max(FREQUENT, places // MOST)).collect()}  # below 3 * MOST rows


def decompose(marked: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of the word's grams: the longest at each place, without those inside an earlier one."""
    out, reached = [], 0
    for p in range(len(marked) - GRAM_MIN + 1):
        q = p + GRAM_MIN
        while q < p + GRAM_MAX and q < len(marked) and marked[p:q] in frequent:
            q += 1
        if q > reached:
            out.append((p, q))
            reached = q
    return out


def affected(marked: str, grams: list[tuple[int, int]], frequent: dict[str, int]) -> int:
    """The most grams of a word that one edit can take from it.

    An edit leaves the characters before i and from j on (j = i: insertion; j = i + 1: replacement or deletion). Before
    it, a gram goes only if one that starts no later may now grow over i: its part up to i is one character or frequent,
    and it starts within reach of i. Behind it, a gram goes only if one that starts before j may cover it.
    """
    n, most = len(marked), 0
    for i in range(n + 1):
        growing = [p for p in range(max(0, i - GRAM_MAX + 1), i) if i - p < GRAM_MIN or marked[p:i] in frequent]
        low = growing[0] if growing else i
        for j in (i, i + 1):
            if j <= n:
                high = j + GRAM_MAX - 1
                most = max(most, sum(p >= low if q <= i else q <= high if p >= j else True for p, q in grams))
    return most


def rare_grams(word: str, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """(gram, start) of the (bound + 1) rarest grams of a word; near words have one of them in common."""
    marked = MARKS[0] + word + MARKS[1]
    grams = decompose(marked, frequent)
    ranked = sorted((frequent.get(marked[p:q], 0), marked[p:q], p) for p, q in grams)
    return [(g, p) for _, g, p in ranked[: affected(marked, grams, frequent) + 1]]


def postings(vocabulary: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """word, n, gram, at, len: the lists of the index."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(frequent)  # below 3 * MOST short strings

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [(w, n, g, at, len(w)) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for g, at in rare_grams(w, shared.value)]
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["word", "n", "gram", "at", "len"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, gram string, at int, len int")


def near_words(lists: DataFrame) -> DataFrame:
    """a, na, b, nb from postings: near words with their occurrences; a pair comes once for each list that it meets in.

    Words of equal length meet in lists of the same place. A word meets those with one character more at the same
    place (the edit comes behind the gram) or at the next one (it comes before).
    """
    kind = lambda at, length: F.struct(at.cast("int").alias("at"), length.cast("int").alias("kind"))
    at, twice = F.col("at"), 2 * F.col("len")
    one = lists.select(F.col("word").alias("a"), F.col("n").alias("na"), "gram", F.inline(F.array(kind(at, twice), kind(at, twice + 1))))
    other = lists.select(F.col("word").alias("b"), F.col("n").alias("nb"), "gram", F.inline(F.array(kind(at, twice), kind(at, twice - 1), kind(at - 1, twice - 1))))
    once = (F.col("kind") % 2 == 1) | (F.col("a") < F.col("b"))
    return one.join(other, ["gram", "at", "kind"]).where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root: where the forms of each word end. A form has TIMES the occurrences, so chains are short.

    Each round doubles the steps that are taken; most (the largest number of occurrences) bounds the steps of a chain.
    """
    steps = max(1, math.ceil(math.log(max(most, 1), TIMES)))
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        out = written(out, "roots")
        nexts = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = out.join(nexts, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return out


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word: its near words, the most frequent as form if it is TIMES as frequent, the last of its forms as root."""
    vocabulary = written(words(docs), "words")
    lists = written(postings(vocabulary, frequent_grams(vocabulary)), "gram-lists")
    pairs = near_words(lists)
    side = lambda word, near, n: F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.col(near).alias("near"))
    both = pairs.select(F.inline(F.array(side("a", "b", "nb"), side("b", "a", "na"))))
    # a word has at most about 200 near words a code point, so this set is small
    sets = both.groupBy("word").agg(F.collect_set(F.struct((-F.col("n")).alias("less"), F.col("near").alias("near"))).alias("s"))
    best = sets.select("word", F.size("s").cast("long").alias("n_near"), F.array_min("s").alias("m"))
    taken = (-F.col("m.less")) >= TIMES * F.col("n")
    known = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("m.near")).alias("form"), F.when(taken, -F.col("m.less")).alias("form_n"))
    known = written(known, "forms")
    discard(lists, vocabulary)
    most = known.agg(F.max("n")).first()[0] or 0  # one number
    ends = roots(known.where("form is not null"), most)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
