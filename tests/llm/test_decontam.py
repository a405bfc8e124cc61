import random

import numpy as np
from panelkit.llm import decontam
from panelkit.llm.decontam import contaminated, drop_contaminated, tiles


def brute(doc, item, least):
    """Greedy tiling by trying all pairs of places."""
    doc, item, out = list(doc), list(item), []
    while True:
        best, at = least - 1, []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and doc[i + n] >= 0 and item[j + n] >= 0:
                    n += 1
                if n > best:
                    best, at = n, []
                if n == best and n >= least:
                    at.append((i, j))
        if not at:
            return out
        for i, j in sorted(at):
            if all(x >= 0 for x in doc[i : i + best]) and all(x >= 0 for x in item[j : j + best]):
                doc[i : i + best] = [-1] * best
                item[j : j + best] = [-2] * best
                out.append((i, j, best))


def test_tiles_as_brute_force():
    r = random.Random(3)
    for _ in range(60):
        item = [r.randint(1, 5) for _ in range(r.randint(0, 25))]
        doc = [r.randint(1, 5) for _ in range(r.randint(0, 40))]
        if len(item) > 8:
            doc += item[len(item) // 2 :] + [9] + item[: len(item) // 2]
        assert tiles(np.array(doc, np.int64), np.array(item, np.int64), 3) == brute(doc, item, 3)


ITEM = "Alpha beta gamma, delta epsilon zeta. Eta theta iota kappa lambda mu nu xi; omicron pi rho sigma tau."


def test_straight_and_reordered_copies_and_clean_texts(spark):
    w = ITEM.split()
    reordered = " ".join(w[10:] + ["and", "then"] + w[:10])
    filler = " ".join(f"word{i}" for i in range(300))
    rows = [(1, filler + " " + ITEM.upper() + " " + filler), (2, reordered), (3, filler), (4, " ".join(w[:7])), (5, None), (6, ""), (None, ITEM), (1, filler + " " + ITEM), (7, (filler + " ") * 100 + ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as coverage")
    bench = spark.createDataFrame([(10, ITEM), (11, "too short here"), (12, None), (13, "")], "item_id long, text string")
    got = contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 10), (1, 10), (1, 10), (2, 10), (7, 10)]
    assert all(r["coverage"] == 1.0 for r in got) and next(r["tiles"] for r in got if r["doc_id"] == 2) == 2
    assert sorted(r["doc_id"] or 0 for r in drop_contaminated(docs, bench).collect()) == [0, 3, 4, 5, 6]


def words_of(t):
    import re

    return re.findall(r"[^\W_]+", (t or "").lower())


def test_query_as_brute_force(spark):
    """All pairs of rows by brute tiling, with reordered, partial and repeated passages, short items, ties and copies."""
    r = random.Random(5)
    w = lambda n: [f"w{r.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(w(r.choice([6, 9, 14, 25])))) for i in range(14)] + [(20, "w1 w2"), (21, "W3!"), (22, None), (23, ""), (None, "q r s t u v"), (5, "other text of item five here")]
    docs = []
    for i in range(60):
        parts = [w(r.randint(0, 20))]
        for _ in range(r.randint(0, 3)):
            x = words_of(r.choice(items)[1])
            k = r.randrange(len(x) + 1)
            parts += [x[k:], w(r.randint(0, 3)), x[:k]] if r.random() < 0.7 else [x[:k]]
        docs.append((i, r.choice([" ", "\n"]).join(" ".join(p) for p in parts)))
    docs += [(3, "w1 w2\nand more w1"), (4, "it is w1 w2"), (None, "w3"), docs[7], (99, None), (98, "w1 " * 3000)]
    want = []
    for d, t in docs:
        for i, x in items:
            dw, iw = words_of(t), words_of(x)
            if not iw:
                continue
            if len(iw) < 5:
                if any(words_of(line) == iw for line in (t or "").split("\n")):
                    want.append((repr(d), repr(i), 1.0, 1))
                continue
            number = {x: k for k, x in enumerate(dict.fromkeys(iw))}
            got = brute([number.get(x, -1) for x in dw if d != 98 or x in number], [number[x] for x in iw], 5)
            share = sum(n for _, _, n in got) / len(iw)
            if share >= 0.5:
                want.append((repr(d), repr(i), share, len(got)))
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'z' as h", "1 as t"))
    assert sorted((repr(x["doc_id"]), repr(x["item_id"]), x["coverage"], x["tiles"]) for x in found.collect()) == sorted(want) and len(want) > 30


def test_long_texts_that_repeat_themselves(spark):
    import time

    item = " ".join(["la"] * 40 + ["end"])
    began = time.time()
    assert tiles(np.zeros(300_000, np.int64), np.zeros(41, np.int64)) == [(0, 0, 41)]
    docs = spark.createDataFrame([(1, "la " * 300_000), (2, "la end " * 100_000), (3, "la")], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], round(r["coverage"], 3)) for r in got] == [(1, 0.976)] and time.time() - began < 60


def test_a_small_filter_changes_nothing(spark, monkeypatch):
    items = [(i, " ".join(f"b{i}x{k}" for k in range(12))) for i in range(60)]
    docs = spark.createDataFrame([(i, "some text " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.FILTER_BITS, decontam.PIECE_BITS):
        monkeypatch.setattr(decontam, "FILTER_BITS", most)
        assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()) == [(i, i) for i in range(60)]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert contaminated(docs, bench.limit(0)).collect() == [] and contaminated(docs.limit(0), bench).collect() == []
    assert drop_contaminated(docs, bench.limit(0)).count() == 1 and drop_contaminated(docs.limit(0), bench).count() == 0
