"""Toxicity by a weighted finite-state pattern grammar.

A text becomes a stream of symbols: insult, threat, target (a person spoken to or of), negation, reported speech, comma
or colon, end of a sentence, other. Three transducers read it in a row, composed into one machine before any text is
read:

1. ``negation``: an insult or threat up to REACH words after a negation in its clause becomes a denied one ("no, you
   ..." denies nothing: a comma ends the clause);
2. ``reported``: one after a verb of saying in its sentence becomes a quoted one, also behind a comma or colon;
3. ``clauses``: emits an event for each pattern matched in a clause: a bare insult, an insult with a target, a threat,
   a threat with a target, a denied one, a quoted one. A comma parts clauses, but a target that stands alone before it,
   or right behind it, belongs to the insult across it ("you, ...", "..., you").

A document's score is a logistic function of its events, weighted by how telling their insult words are. Which words
and word beginnings are insults is learned from labelled documents, and so are words that deny (they stand before
insults in clean documents) besides a few known ones, and the weight of each event.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Bound of the labelled sample: documents of each label, by hash of their ids. All that is learned comes from these.
SAMPLE = 3000
#: A feature is an insult if it occurs in so many unlike documents and so large a share of them is toxic.
LEAST_DOCS, LEAST_SHARE = 4, 0.9
#: Lengths of the word beginnings that can be learned.
STEMS = (4, 5, 6)
REACH = 3
OTHER, END, COMMA, TARGET, NEGATION, REPORT, THREAT, INSULT = range(8)

_TOKENS = re.compile(r"[^\W_]+|[.!?;:,\n。！？；：，、؟।]")
_COMMAS = set(",:，、：")
_CUES = {
    TARGET: "you your yours yourself he she him her they them their these those du dich dir dein ihr euch sie tu te toi ton ta vous votre ils elles tú usted ustedes ellos ellas",
    NEGATION: "not no never none nobody neither without nicht kein keine nie niemals ohne pas jamais aucun sans nunca jamás ninguno sin",
    REPORT: "said says say wrote writes claimed claims called quoted reported according sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según",
    THREAT: "kill hurt destroy murder shoot burn stab beat hang töten umbringen verletzen zerstören tuer détruire blesser frapper matar destruir herir golpear",
}
_CUE_OF = {w: k for k, ws in _CUES.items() for w in ws.split()}


@dataclass
class Transducer:
    """Deterministic: (state, symbol) to (state, output symbols). A missing arc keeps the state and copies the symbol."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, (symbol,)))


def compose(first: Transducer, second: Transducer, alphabet: list) -> Transducer:
    """The machine that feeds the output of first to second, with all reachable arcs spelled out."""
    start = (first.start, second.start)
    out, todo, seen = Transducer(start), [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in alphabet:
            na, mid = first.step(a, symbol)
            nb, emitted = b, ()
            for m in mid:
                nb, more = second.step(nb, m)
                emitted += more
            out.arcs[state, symbol] = ((na, nb), emitted)
            if (na, nb) not in seen:
                seen.add((na, nb))
                todo.append((na, nb))
    return out


ALPHABET = list(range(8))
EVENTS = ("insult", "insult at target", "threat", "threat at target", "denied", "quoted")
AT_TARGET, DENIED = (1, 3), 4


def negation(reach: int = REACH) -> Transducer:
    t = Transducer(0)
    for left in range(reach + 1):
        t.arcs[left, NEGATION] = (reach, (NEGATION,))
        for s in (END, COMMA):
            t.arcs[left, s] = (0, (s,))
        for s in (OTHER, TARGET, REPORT):
            t.arcs[left, s] = (max(0, left - 1), (s,))
        for s in (INSULT, THREAT):
            t.arcs[left, s] = (max(0, left - 1), ("denied" if left else s,))
    return t


def reported() -> Transducer:
    t = Transducer("own")
    t.arcs["own", REPORT] = ("said", (REPORT,))
    t.arcs["said", END] = ("own", (END,))
    for s in (INSULT, THREAT):
        t.arcs["said", s] = ("said", ("quoted",))
    return t


def clauses() -> Transducer:
    """States: what the clause holds (nothing, no target, targets alone, a target and other words) and what waits.

    An insult or threat waits for a target to the clause's end, or to the first word behind its comma.
    """
    t = Transducer(("nothing", None))
    after = {"nothing": "none", "none": "none", "alone": "any", "any": "any"}
    for holds in after:
        target = holds in ("alone", "any")
        for waits in (None, "insult", "threat", "insult,", "threat,"):
            s = (holds, waits)
            kind = waits.rstrip(",") if waits else None
            bare = (EVENTS.index(kind),) if kind else ()
            across = bool(waits) and waits.endswith(",")
            t.arcs[s, END] = (("nothing", None), bare)
            t.arcs[s, TARGET] = (("alone" if holds in ("nothing", "alone") else "any", None), (EVENTS.index(kind + " at target"),) if kind else ())
            if kind and not across:
                t.arcs[s, COMMA] = (("nothing", kind + ","), ())
            else:
                t.arcs[s, COMMA] = (("alone" if holds == "alone" else "nothing", None), bare)
            # any word but a target ends the wait across a comma
            told, held = (bare, None) if across else ((), waits)
            for own, symbol in (("insult", INSULT), ("threat", THREAT)):
                t.arcs[s, symbol] = (("any", None), (*told, EVENTS.index(own + " at target"))) if target else (("none", own), bare)
            for symbol in ("denied", "quoted"):
                t.arcs[s, symbol] = ((after[holds], held), (*told, EVENTS.index(symbol)))
            for symbol in (OTHER, NEGATION, REPORT):
                t.arcs[s, symbol] = ((after[holds], held), told)
    return t


def grammar() -> tuple[np.ndarray, list[list[tuple[int, ...]]]]:
    """(next state, events) by state number and symbol; state 0 is the start."""
    m = compose(compose(negation(), reported(), ALPHABET), clauses(), ALPHABET)
    states = {m.start: 0}
    for (s, _), (n, _) in m.arcs.items():
        states.setdefault(s, len(states))
        states.setdefault(n, len(states))
    nxt = np.zeros((len(states), len(ALPHABET)), np.int64)
    events: list[list[tuple[int, ...]]] = [[()] * len(ALPHABET) for _ in states]
    for (s, c), (n, e) in m.arcs.items():
        nxt[states[s], c] = states[n]
        events[states[s]][c] = e
    return nxt, events


def features(word: str) -> list[str]:
    """What can be learned of a word: itself and its beginnings (marked ~)."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


class Reader:
    """Symbols of words, remembered; the memory starts anew at a fixed size."""

    def __init__(self, lexicon: dict[str, float], denials: frozenset[str] = frozenset()):
        outer = self
        self.lexicon, self.denials = lexicon, denials

        class Known(dict):
            def __missing__(self, w):
                if len(self) > 300_000:
                    self.clear()
                got = self[w] = outer.classify(w)
                return got

        self.known = Known()
        self.next, self.events = grammar()
        self.next = self.next.tolist()

    def classify(self, w: str) -> tuple[int, float]:
        if not w[0].isalnum():
            return (COMMA if w in _COMMAS else END, 0.0)
        weight = max((self.lexicon.get(f, 0.0) for f in features(w)), default=0.0)
        if weight:
            return (INSULT, weight)
        return (NEGATION if w in self.denials else _CUE_OF.get(w, OTHER), 0.0)

    def before(self, text: str) -> set[str]:
        """The words up to REACH places before an insult in its clause."""
        out, held = set(), []
        for w in _TOKENS.findall(text.lower()):
            c, _ = self.known[w]
            if c in (END, COMMA):
                held = []
                continue
            if c == INSULT:
                out.update(held)
            held = [*held, w][-REACH:]
        return out

    def row(self, text: str) -> list[float]:
        """Sum of weights of each event, insults' weights counting from the lexicon and threats' as 1."""
        out = [0.0] * len(EVENTS)
        got = list(map(self.known.__getitem__, _TOKENS.findall(text.lower())))
        if not any(c >= THREAT for c, _ in got):
            return out
        state, waiting = 0, 0.0
        for c, w in (*got, (END, 0.0)):
            own = w or 1.0
            mine = False
            for e in self.events[state][c]:
                # denied, quoted or at a target known before: this word's own; else of the one that waited
                if c >= THREAT and (e >= DENIED or e in AT_TARGET):
                    mine = True
                    out[e] += own
                else:
                    out[e] += waiting
            if c >= THREAT and not mine:
                waiting = own
            state = self.next[state][c]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept.

    A step is halved until it lowers the penalised loss, so the rounds converge also where the classes part without an
    error and columns are nearly the same.
    """
    z = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-3]

    def loss(b: np.ndarray) -> float:
        at = z @ b
        return float(weight @ (np.logaddexp(0, at) - y * at) + 0.5 * penalty @ (b * b))

    now = loss(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -500, 500)))
        g = z.T @ (weight * (p - y)) + penalty * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        while (new := loss(b - step)) > now and np.abs(step).max() >= 1e-8:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        b, now = b - step, new
    return b


def inputs(rows: np.ndarray) -> np.ndarray:
    """What the logistic function reads: each event's sum, and those of all own insults and all own threats together."""
    return np.log1p(np.column_stack([rows, rows[:, 0] + rows[:, 1], rows[:, 2] + rows[:, 3]]))


@dataclass
class Model:
    lexicon: dict[str, float]
    denials: frozenset[str]
    weights: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(rows) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3) -> Model:
    """A model of labelled documents that are not held out (crc32 of doc_id mod folds is fold).

    Bounded: at most SAMPLE documents of each label, those with the least hashes of their ids. Documents that share
    their least shingle hash, as copies and near copies do, count once for each word. Without labels of both kinds
    every score is the share of toxic labels (0 without any).
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != fold)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        share = 0.0 if not n else float(1 in n)
        return Model({}, frozenset(), np.r_[np.zeros(len(EVENTS) + 2), 30.0 if share else -30.0])
    some = [known.where(F.col("toxic") == k).withColumn("h", F.xxhash64("doc_id", F.lit("toxic"))).orderBy("h", "doc_id").limit(SAMPLE) for k in (0, 1)]
    picked = [(r["doc_id"], r["toxic"]) for s in some for r in s.select("doc_id", "toxic").collect()]
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int"))  # 2 * SAMPLE rows
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")

    def split(batches):
        import pyarrow as pa

        for b in batches:
            f, k, t = [], [], []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = [w for w in _TOKENS.findall((text or "").lower()) if w[0].isalpha()]
                like = min((xxhash.xxh64_intdigest(" ".join(s)) >> 1 for s in zip(ws, ws[1:], ws[2:])), default=0)
                for x in {x for w in set(ws) for x in features(w)}:
                    f.append(x)
                    k.append(like)
                    t.append(toxic)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(k, pa.int64()), pa.array(t, pa.int32())], names=["f", "k", "toxic"])

    seen = sample.select("text", "toxic").mapInArrow(split, "f string, k long, toxic int").groupBy("f", "k").agg(F.max("toxic").alias("toxic"))
    per = seen.groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    # the sample takes a smaller share of clean documents: their counts stand for more; half a document is added to them
    up = max(1.0, (n[0] / min(n[0], SAMPLE)) / (n[1] / min(n[1], SAMPLE)))
    share = F.col("t") / (F.col("t") + F.lit(up) * (F.col("c") + 0.5))
    telling = per.where((F.col("t") >= LEAST_DOCS) & (share >= LEAST_SHARE)).collect()  # of 2 * SAMPLE documents at most
    lexicon = {r["f"]: float(np.log((r["t"] + 0.5) / (up * r["c"] + 0.5))) for r in telling}
    shared = spark.sparkContext.broadcast(lexicon)

    def context(batches):
        import pyarrow as pa

        reader = Reader(shared.value)
        for b in batches:
            got = [(w, t) for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in reader.before(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([t for _, t in got], pa.int32())], names=["w", "toxic"])

    near = sample.select("text", "toxic").mapInArrow(context, "w string, toxic int").groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    denials = frozenset(r["w"] for r in near.where((F.col("c") >= LEAST_DOCS) & (F.lit(up) * F.col("c") >= LEAST_SHARE * (F.col("t") + F.lit(up) * F.col("c")))).collect())

    def rows(batches):
        import pyarrow as pa

        reader = Reader(shared.value, denials)
        for b in batches:
            got = [reader.row(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, pa.float64()) for c in zip(*got, strict=True))], names=["toxic", *(f"e{i}" for i in range(len(EVENTS)))])

    table = sample.select("text", "toxic").mapInArrow(rows, "toxic int, " + ", ".join(f"e{i} double" for i in range(len(EVENTS)))).toPandas()
    y = table["toxic"].to_numpy(float)
    weight = np.where(y == 1, 1.0, up)
    return Model(lexicon, denials, fit(inputs(table.drop(columns="toxic").to_numpy(float)), y, weight))


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, from the whole text alone.

    Null and empty texts get the score of a text without any event. A null doc_id counts as not held out. Empty tables
    give no rows. Other columns are ignored, whatever their names.
    """
    model = learn(docs, labels, fold, folds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        reader = Reader(m.lexicon, m.denials)
        for b in batches:
            if not b.num_rows:
                continue
            s = m.score(np.array([reader.row(t or "") for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_mod("doc_id", folds) == fold, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
