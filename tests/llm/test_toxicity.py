import random
import zlib

import numpy as np
from panelkit.llm.toxicity import COMMA, END, EVENTS, INSULT, NEGATION, OTHER, REACH, REPORT, TARGET, THREAT, Reader, fit, inputs, learn, score_toxicity


def events(text):
    row = Reader({"fool": 2.0, "scum": 3.0, "vequ~": 1.5}).row(text)
    return {e: v for e, v in zip(EVENTS, row, strict=True) if v}


def test_grammar():
    assert events("What a fool.") == {"insult": 2.0}
    assert events("You are scum.") == {"insult at target": 3.0}
    assert events("Scum you are") == {"insult at target": 3.0}
    assert events("You are not a fool.") == {"denied": 2.0}
    assert events("She said he is a fool. Scum!") == {"quoted": 2.0, "insult": 3.0}
    assert events("I will hurt you") == {"threat at target": 1.0}
    assert events("not here. fool") == {"insult": 2.0}
    assert events("la vequment est") == {"insult": 1.5}
    assert events("") == {} and events("nothing at all") == {}


def test_clauses_and_reports():
    assert events("fool goes, not scum.") == {"insult": 2.0, "denied": 3.0}
    assert events("scum, he said fool") == {"insult at target": 3.0, "quoted": 2.0}
    assert events("He said: you are a fool.") == {"quoted": 2.0} == events("He said, you are a fool.")
    assert events("You are right, that fool left") == {"insult": 2.0}
    assert events("You, fool!") == {"insult at target": 2.0} == events("Fool, you lost")
    assert events("Fool, the train left you") == {"insult": 2.0}
    assert events("No, you fool") == {"insult at target": 2.0}
    assert events("这，fool。你") == {"insult": 2.0}


def walk(symbols):
    """The three machines by hand: (event, place of its word) in the order of places."""
    out, left, said = [], 0, False
    marked = []
    for s in symbols:
        x = s
        if s in (INSULT, THREAT):
            x = "quoted" if said and not left else "denied" if left else s
        if s == NEGATION:
            left = REACH
        else:
            left = 0 if s in (END, COMMA) else max(0, left - 1)
        said = (said or s == REPORT) and s != END
        marked.append(x)
    # sentences to clauses, each a list of (symbol, place)
    clauses, ends = [[]], []
    for i, x in enumerate(marked):
        if x in (END, COMMA):
            ends.append(x)
            clauses.append([])
        else:
            clauses[-1].append((x, i))
    ends.append(END)
    kind = {INSULT: "insult", THREAT: "threat"}
    vocative = False
    for n, c in enumerate(clauses):
        target = vocative
        held = None
        for at, (x, i) in enumerate(c):
            if x == TARGET:
                if held is not None:
                    out.append((kind[held[0]] + " at target", held[1]))
                    held = None
                target = True
            elif x in kind:
                if target:
                    out.append((kind[x] + " at target", i))
                else:
                    if held is not None:
                        out.append((kind[held[0]], held[1]))
                    held = (x, i)
            elif x in ("denied", "quoted"):
                out.append((x, i))
        if held is not None:
            follows = ends[n] == COMMA and n + 1 < len(clauses) and clauses[n + 1] and clauses[n + 1][0][0] == TARGET
            out.append((kind[held[0]] + (" at target" if follows else ""), held[1]))
        alone = all(x == TARGET for x, _ in c) and (vocative or bool(c))
        vocative = ends[n] == COMMA and alone
    return sorted(out, key=lambda e: e[1])


def test_machine_as_a_walk_by_hand():
    """The composed machine and its weights against a plain walk over clauses."""
    r = random.Random(8)
    words = {OTHER: "xx", END: ".", COMMA: ",", TARGET: "you", NEGATION: "not", REPORT: "said", THREAT: "kill", INSULT: "fool"}
    reader = Reader({"fool": 2.0, "scum": 3.0})
    for _ in range(4000):
        symbols = [r.choice(list(words)) for _ in range(r.randint(0, 12))]
        text = [r.choice(["fool", "scum"]) if s == INSULT else words[s] for s in symbols]
        want = [0.0] * len(EVENTS)
        for e, at in walk(symbols):
            want[EVENTS.index(e)] += {"fool": 2.0, "scum": 3.0}.get(text[at], 1.0)
        assert reader.row(" ".join(text)) == want, text


def test_query_as_brute_force(spark):
    """Scores of the whole operator against scoring text by text, a very long one among them."""
    docs, labels = corpus()
    docs.append((7000, " ".join(t for _, t in docs) * 8))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = learn(d, lab)
    assert {"blork", "snarg"} <= set(m.lexicon)
    reader = Reader(m.lexicon, m.denials)
    got = {r["doc_id"]: r["score"] for r in score_toxicity(d, lab).collect()}
    for i, t in docs:
        x = np.log1p(np.array(reader.row(t)))
        own = np.log1p([sum(reader.row(t)[:2]), sum(reader.row(t)[2:4])])
        z = float(np.r_[x, own] @ m.weights[:-1] + m.weights[-1])
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
    assert got[7000] > 0.9


def test_words_that_deny_are_learned(spark):
    r = random.Random(3)
    w = lambda n: " ".join(f"v{r.randrange(500)}" for _ in range(n))
    docs = [(i, f"{w(20)} {'hardly a blork' if i % 80 == 1 else 'blork' if i % 4 == 0 else 'calm'} {w(20)} {'snarg' if i % 4 == 0 else ''}") for i in range(1200)]
    m = learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int"))
    assert "hardly" in m.denials and "blork" in m.lexicon


def corpus(n=900):
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        toxic = int(r.random() < 0.2)
        for _ in range(4 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["blork", "snarg", "zuqi" + r.choice(vocab)]))
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_rows_of_every_kind(spark):
    docs, labels = corpus()
    extra = [(None, "blork"), (5000, None), (5001, ""), (0, docs[0][1])]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "'en' as lang", "0.5 as score")
    got = score_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) + 4
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert len(held) > 200 and sum(truth[r["doc_id"]] == r["predicted"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert score_toxicity(d, spark.createDataFrame([], "doc_id long, toxic int")).first()["predicted"] == 0
    assert score_toxicity(d.limit(0), spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (5, 1), (6, 0)], "doc_id long, toxic int")).collect() == []


def test_fit_converges_where_classes_part():
    """Many toxic rows, clean ones all zero and heavy, two columns nearly the same: as a large labelled sample gives."""
    r = np.random.default_rng(1)
    rows = np.zeros((6000, len(EVENTS)))
    rows[:3000, 0] = np.exp(r.normal(4, 0.8, 3000))
    rows[:3000, 1] = np.where(r.random(3000) < 0.27, r.uniform(6, 20, 3000), 0)
    rows[:3000, 4] = np.where(r.random(3000) < 0.035, 7.4, 0)
    x, y, weight = inputs(rows), np.repeat([1.0, 0.0], 3000), np.repeat([1.0, 8.78], 3000)
    b = fit(x, y, weight)
    z = np.column_stack([x, np.ones(len(x))])
    p = 1 / (1 + np.exp(-z @ b))
    assert np.abs(z.T @ (weight * (p - y)) + np.r_[np.ones(x.shape[1]), 1e-3] * b).max() < 1e-6
    assert (p[y == 1] >= 0.7).mean() > 0.99 and p[y == 0].max() < 0.1
