import math
import random
import zlib

import numpy as np
import pytest
from panelkit.llm import quality
from panelkit.llm.quality import STATISTICS, document_statistics, fit, learn, score_quality, statistics

DOCS = "doc_id long, text string"


def prose(r, n):
    w = ["".join(r.choice("aeioulnrstdm") for _ in range(r.randrange(2, 9))) for _ in range(n)]
    return ". ".join(" ".join(w[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


def corpus(n=700, seed=4):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, bad = prose(r, r.randrange(20, 150)), r.random() < 0.3
        if bad:
            k = r.randrange(4)
            text = [lambda t: t.upper() + "!!", lambda t: " | ".join(t.split()), lambda t: "### ".join(t.split()), lambda t: "\n".join([t[:60]] * 12)][k](text)
        docs.append((i, text))
        labels.append((i, int(not bad)))
    return docs, labels


def test_statistics_by_plain_counts():
    text = "The cat sat.\nThe cat sat.\n\nÉté!! 42 (x)  ##"
    s = dict(zip(STATISTICS, statistics(text.encode()), strict=True))
    raw, words = text.encode(), text.split()
    assert len(s) == len(STATISTICS)
    assert s["log_bytes"] == pytest.approx(math.log1p(len(raw))) and s["log_words"] == pytest.approx(math.log1p(len(words)))
    assert s["share_upper"] == pytest.approx(2 / len(raw)) and s["share_wide"] == pytest.approx(4 / len(raw)) and s["share_line"] == pytest.approx(3 / len(raw))
    assert s["word_mean"] == pytest.approx(sum(len(w.encode()) for w in words) / len(words))
    assert s["distinct_words"] == pytest.approx(len(set(words)) / len(words)) and s["top_word"] == pytest.approx(2 / len(words))
    assert s["distinct_triples"] == pytest.approx(len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}) / (len(words) - 2))
    assert s["repeated_lines"] == pytest.approx(1 / 3) and s["doubled_marks"] == pytest.approx(2 / len(raw))
    assert s["begins_upper"] == pytest.approx(2 / len(words)) and s["ends_mark"] == pytest.approx(3 / len(words)) and s["ends_symbol"] == pytest.approx(1 / len(words))
    assert not statistics(b"").any() and np.isfinite(statistics(b" \n\t ")).all()


def test_whole_texts_in_pieces(monkeypatch):
    text = (prose(random.Random(1), 4000) + "!! ## ").encode()
    whole = dict(zip(STATISTICS, statistics(text), strict=True))
    monkeypatch.setattr(quality, "PIECE", 2000)
    parts = dict(zip(STATISTICS, statistics(text), strict=True))
    for name in STATISTICS:
        if not name.startswith(("distinct", "top", "repeated", "words_a_line")):  # counted within pieces
            assert parts[name] == pytest.approx(whole[name], rel=2e-2, abs=1e-4), name


def test_flat_trees_as_a_walk(monkeypatch):
    monkeypatch.setattr(quality, "USED", 1.0)
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(400, 5)), 1)
    y = ((x[:, 0] > 0.2) & (x[:, 1] > -0.5) | (x[:, 2] > 1)).astype(float)
    f = fit(x, y, np.where(y == 1, 1.0, 2.0), trees=20, depth=3)
    for i in range(400):
        z = f.start
        for t in range(20):
            at = 0
            while at < 7:
                at = 2 * at + (2 if x[i, f.feature[t, at]] > f.threshold[t, at] else 1)
            z += f.value[t, at - 7]
        assert f.raw(x[i : i + 1])[0] == pytest.approx(z)
    assert ((f.score(x) > 0.5) == (y == 1)).mean() > 0.9
    assert (fit(x, y, np.ones(400), trees=5, depth=3).value == fit(x, y, np.ones(400), trees=5, depth=3).value).all()


def test_first_split_is_the_best_of_all(monkeypatch):
    monkeypatch.setattr(quality, "USED", 1.0)
    r = np.random.default_rng(2)
    x, y = np.round(r.normal(size=(300, 3)), 1), (r.random(300) < 0.5).astype(float)
    f, g = fit(x, y, np.ones(300), trees=1, depth=1), y - y.mean()
    h = y.mean() * (1 - y.mean())
    gain = lambda left: sum(g[m].sum() ** 2 / (h * m.sum() + quality.RIDGE) for m in (left, ~left))
    every = [gain(x[:, k] <= c) for k in range(3) for c in np.unique(x[:, k]) if min((x[:, k] <= c).sum(), (x[:, k] > c).sum()) >= quality.LEAST]
    assert gain(x[:, f.feature[0, 0]] <= f.threshold[0, 0]) == pytest.approx(max(every))


def test_query_as_brute_force_and_held_out_accuracy(spark):
    docs, labels = corpus()
    extra = [(None, docs[0][1]), (5000, None), (5001, ""), (0, docs[0][1]), (5002, " ".join(t for _, t in docs) * 3)]
    d = spark.createDataFrame(docs + extra, DOCS).selectExpr("*", "'en' as lang", "0.5 as score", "array(1) as x")
    lab = spark.createDataFrame(labels + [(3, 0), (9999, 1), (9998, None)], "doc_id long, quality int")
    got = score_quality(d, lab).collect()
    assert len(got) == len(docs) + 5
    f = learn(document_statistics(d, 2, 4), lab)
    by = dict(docs) | {i: t or "" for i, t in extra if i is not None}
    for r in got:
        want = f.score(statistics((docs[0][1] if r["doc_id"] is None else by[r["doc_id"]]).encode()).astype(np.float32).astype(float)[None])[0]
        assert r["score"] == pytest.approx(want) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 150 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert len({r["score"] for r in got if r["doc_id"] in (5000, 5001)}) == 1


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, DOCS)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    score = lambda rows: {r["doc_id"]: r["score"] for r in score_quality(d, spark.createDataFrame(rows, "doc_id long, quality int")).collect()}
    assert score(labels) == score(flipped)


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert score_quality(d, none).first()["predicted"] == 0
    assert score_quality(d, spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")).first()["predicted"] == 1
    assert score_quality(d.limit(0), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")).collect() == []


def test_accuracy_on_the_given_tables(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels).where("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    clean, low = ([r["predicted"] for r in got if r["quality"] == q] for q in (1, 0))
    assert len(clean) > 800 and sum(clean) >= 0.995 * len(clean)
    assert len(low) > 100 and sum(low) <= 0.05 * len(low)
