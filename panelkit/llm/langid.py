"""Language identification by cross-parsing.

For each language a suffix automaton holds a bounded sample of labelled text. A document is parsed against it into
phrases: each is the longest prefix of the rest that occurs in the sample, at least one character. The fewer phrases,
the closer the text; the count is normalised by the logarithm of the sample's length, as each phrase costs a pointer
into it. The language with the least cost wins.

The automaton is kept as a double array: the edge of state s by character c, if there is one, stands at base[s] + c and
says there that it is of s. So it takes room for its edges only, whatever the number of characters. Text is folded to
lower-case letters, all between them to one space.

Whole texts are parsed, but numpy steps through many places at once: a text is cut into pieces that are first parsed
each by itself. Then each piece is parsed anew from the state in which the piece before it really ends, up to where a
phrase begins at the same place in both; from there on they are the same. So the phrases are those of the whole text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Bounds of the labelled sample: documents and folded characters of each language, and characters of all languages
#: together (with more than 64 of them each gets less).
SAMPLE_DOCS, SAMPLE_CHARS, ALL_CHARS = 120, 32_000, 64 * 32_000
#: Characters of a document that the sample takes at most, so that no single one fills it.
PART = 4_000
#: Phrases that a text may have besides those that tell its language: short texts are not rejected.
ALLOWED = 6
#: Characters of a piece; pieces and folded characters that are walked together.
PIECE, LANES, BATCH_CHARS = 256, 8192, 2_000_000
SPACE, FOREIGN = 0, 1

_fold_table = None


def _folded_points() -> np.ndarray:
    """For each code point below 65536: its lower-case letter, or 0 if it is no letter."""
    global _fold_table
    if _fold_table is None:
        t = np.zeros(65536, np.uint32)
        for c in range(65536):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _fold_table = t
    return _fold_table


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, lengths): letters in lower case, each run of other characters as one 0; no 0 at either end."""
    joined = "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    t = _folded_points()
    points = np.where(raw < 65536, t[np.minimum(raw, 65535)], 0).astype(np.uint32)
    for c in np.unique(raw[raw >= 65536]).tolist():
        if chr(c).isalpha():
            points[raw == c] = c
    ends = np.cumsum([len(x) + 1 for x in texts])
    first = np.r_[0, ends[:-1]]
    gap = points == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # the first of each run of others
    keep[first[gap[first]]] = False
    # a run that goes on past a document's start was kept at its beginning only; the one kept at an end is dropped
    before = np.cumsum(keep)
    n = np.diff(np.r_[0, before[ends - 1]])
    out = points[keep]
    if not len(out):
        return out, n
    at = np.cumsum(n)
    last = (n > 0) & (out[np.maximum(at - 1, 0)] == 0)
    if last.any():
        out = np.delete(out, at[last] - 1)
        n = n - last
    return out, n


@dataclass
class Automaton:
    """A suffix automaton as a double array; state 0 is the root."""

    base: np.ndarray
    check: np.ndarray
    to: np.ndarray
    first: np.ndarray  # the state behind a phrase's first character

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins with this character)."""
        at = self.base[state] + c
        goes_on = (self.check[at] == state) & (state > 0)
        return np.where(goes_on, self.to[at], self.first[c]), ~goes_on


def automaton(s: list[int], letters: int) -> Automaton:
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    size = sum(map(len, nxt))
    base, check, to = np.zeros(len(nxt), np.int32), [-1] * (2 * size + 3 * letters), [0] * (2 * size + 3 * letters)
    free = hint = letters
    for state in sorted(range(len(nxt)), key=lambda i: -len(nxt[i])):  # the widest first; those of one edge fill the gaps
        edges = nxt[state]
        if not edges:
            continue
        lead = next(iter(edges))
        if len(edges) == 1:
            while check[free] >= 0:
                free += 1
            at = free
        else:
            at = hint
            while check[at] >= 0 or any(check[at - lead + c] >= 0 for c in edges):
                at += 1
                if at + letters >= len(check):
                    check += [-1] * len(check)
                    to += [0] * len(to)
            hint = max(hint, at - 16)
        base[state] = at - lead
        for c, v in edges.items():
            check[at - lead + c], to[at - lead + c] = state, v
        if free + letters >= len(check):
            check += [-1] * len(check)
            to += [0] * len(to)
    first = np.zeros(letters, np.int32)
    for c, v in nxt[0].items():
        first[c] = v
    top = int(base.max()) + letters if len(base) else letters
    return Automaton(base, np.array(check[:top], np.int32), np.array(to[:top], np.int32), first)


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray  # code points, ascending; codes follow from 2
    automata: list[Automaton]
    cost: np.ndarray  # bits per phrase
    foreign: float  # least bits per character of one language's sample under another's automaton; inf with one language

    def encode(self, points: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.where(points == 0, SPACE, FOREIGN).astype(np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        known = self.alphabet[at] == points
        return np.where(points == 0, SPACE, np.where(known, at + 2, FOREIGN)).astype(np.int32)

    def phrases(self, points: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(documents, languages): phrases of each whole document."""
        code = self.encode(points)
        pieces = (n + PIECE - 1) // PIECE
        owner = np.repeat(np.arange(len(n)), pieces)
        start = np.repeat(np.cumsum(n) - n, pieces) + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(PIECE, np.repeat(np.cumsum(n), pieces) - start)
        follows = np.r_[False, owner[1:] == owner[:-1]] if len(owner) else np.zeros(0, bool)
        out = np.zeros((len(n), len(self.languages)), np.int64)
        for k, a in enumerate(self.automata):
            begins = np.zeros(len(code), bool)
            end = np.zeros(len(owner), np.int32)
            order = np.argsort(-size, kind="stable")
            for at in range(0, len(order), LANES):
                lanes = order[at : at + LANES]
                state = np.zeros(len(lanes), np.int32)
                live = np.searchsorted(-size[lanes], -np.arange(int(size[lanes[0]])), side="left")  # lanes longer than each step
                for t, m in enumerate(live.tolist()):
                    where = start[lanes[:m]] + t
                    state[:m], begins[where] = a.step(state[:m], code[where])
                end[lanes] = state
            # pieces that go on a text: again from the true state, until a phrase begins in both parses at one place
            todo = np.flatnonzero(follows)
            while len(todo):
                lanes, state, t, was = todo, end[todo - 1], 0, end[todo].copy()
                while len(lanes):
                    where = start[lanes] + t
                    state, new = a.step(state, code[where])
                    both = new & begins[where]
                    begins[where] = new
                    t += 1
                    over = ~both & (size[lanes] == t)
                    end[lanes[over]] = state[over]
                    on = ~both & ~over
                    lanes, state = lanes[on], state[on]
                moved = todo[end[todo] != was] + 1
                todo = moved[moved < len(owner)]
                todo = todo[follows[todo]]
            out[:, k] = np.bincount(np.repeat(np.arange(len(n)), n), begins, len(n)).astype(np.int64)
        return out


def build(samples: dict[str, str]) -> Model:
    """Samples of text by language to a model."""
    names = sorted(samples)
    text = {k: folded([samples[k]])[0] for k in names}
    # equal lengths, so that no language gains by a larger sample; the whole of those that are shorter
    most = min(SAMPLE_CHARS, ALL_CHARS // max(1, len(names)))
    text = {k: v[:most] for k, v in text.items() if len(v)}
    names = [k for k in names if k in text]
    alphabet = np.unique(np.concatenate([v[v != 0] for v in text.values()])) if names else np.empty(0, np.uint32)
    model = Model(names, alphabet, [], np.array([np.log2(max(2, len(text[k]))) for k in names]), float("inf"))
    model.automata = [automaton(model.encode(text[k]).tolist(), len(alphabet) + 2) for k in names]
    if len(names) > 1:
        n = np.array([len(text[k]) for k in names])
        bits = model.phrases(np.concatenate([text[k] for k in names]), n) * model.cost / n[:, None]
        np.fill_diagonal(bits, np.inf)
        model.foreign = float(bits.min())
    return model


def costs(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of each text by language, folded characters of each, letters of each)."""
    points, n = folded(texts)
    letters = np.bincount(np.repeat(np.arange(len(n)), n), points != 0, len(n)) if len(points) else np.zeros(len(n))
    return model.phrases(points, n) * model.cost, n, letters


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
    """Language and score of each text, and whether it is told: `und` and 0.0 without a letter (or a learned language).

    The score is the winner's share of exp(-cost) over the languages: near 1 where the others cost many bits more.
    A text is told if it has a letter and its language costs less, by the character, than one learned language does
    under the automaton of another (see told()).
    """
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts), [any(map(str.isalpha, t)) for t in texts]
    cost, n, letters = costs(model, texts)
    best = cost.argmin(axis=1)
    least = cost.min(axis=1)
    score = 1 / np.exp2(np.maximum(-60.0, least[:, None] - cost)).sum(axis=1)
    ok = letters > 0
    sure = ok & told(least, n, model)
    return [model.languages[b] if y else "und" for b, y in zip(best, ok, strict=True)], [float(s) if y else 0.0 for s, y in zip(score, ok, strict=True)], sure.tolist()


def told(bits: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """Whether a text's bits, but for ALLOWED phrases, are fewer than those of as long a text in a foreign language."""
    return (n > 0) & (bits - ALLOWED * model.cost.max(initial=0.0) < model.foreign * np.maximum(n, 1))


def learn(docs: DataFrame, fold: int = 2, folds: int = 4) -> Model:
    """A model of the rows that have text and lang and are not held out (crc32 of doc_id mod folds is fold).

    Bounded: of each label about SAMPLE_DOCS documents by hash of their ids, then SAMPLE_CHARS folded characters of
    those (less with very many labels). Every label is learned.
    """
    held = F.coalesce(crc_mod("doc_id", folds) == fold, F.lit(False))
    rows = docs.select("doc_id", "text", "lang").where(~held & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_003))
    share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_DOCS) / F.col("n"))
    some = rows.join(F.broadcast(counts), "lang").withColumn("draw", draw).where(F.col("draw") < share * 1_000_003)  # one row a label
    got: dict[str, list[str]] = {}
    size: Counter = Counter()
    # about 2 * SAMPLE_DOCS parts of texts a language reach the driver
    for r in some.select("lang", "draw", "doc_id", F.substring("text", 1, PART).alias("text")).orderBy("draw", "doc_id").toLocalIterator():
        if size[r["lang"]] < 2 * SAMPLE_CHARS and len(got.setdefault(r["lang"], [])) < SAMPLE_DOCS:
            got[r["lang"]].append(r["text"])
            size[r["lang"]] += len(r["text"])
    return build({k: " ".join(v) for k, v in got.items()})


def identify_languages(docs: DataFrame, model: Model | None = None, fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of docs; every whole text is parsed.

    lang_pred is a learned label, or `und` with score 0.0 where the text is null or has no letter. Ties go to the
    label that sorts first. A null doc_id counts as not held out. Empty tables give no rows. lang is read only for
    learning; docs needs no lang column if a model is given. Other columns are ignored, whatever their names.
    """
    model = model or learn(docs, fold, folds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most about 20 bytes for each of ALL_CHARS

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            names, scores, at, size = [], [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BATCH_CHARS or i == len(texts) - 1:
                    got = predict(m, texts[at : i + 1])
                    names += got[0]
                    scores += got[1]
                    at, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_mod("doc_id", folds) == fold, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """docs without the documents whose language can't be told; all columns are kept.

    These go: null texts, texts without a letter, and texts in none of the learned languages, that is those whose best
    language costs as many bits by the character as one learned language's text under another's automaton. Without any
    labelled row, or with one language, only texts without a letter go. Ties, repeated rows and null ids make no
    difference, as each row is judged by its text alone; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            keep, at, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BATCH_CHARS or i == len(texts) - 1:
                    keep += predict(m, texts[at : i + 1])[2]
                    at, size = i + 1, 0
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
