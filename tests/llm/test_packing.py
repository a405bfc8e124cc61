import random

from panelkit.llm.packing import best_fit, pack_documents, packed_texts, word_count


def naive(items, capacity):
    order = sorted(range(len(items)), key=lambda i: -items[i][0])
    bins, out = [], [0] * len(items)
    for i in order:
        size, s, c = items[i]
        ok = [(b["left"], n) for n, b in enumerate(bins) if b["left"] >= size and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if ok:
            n = min(ok)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            n = len(bins) - 1
        bins[n]["left"] -= size
        bins[n]["s"].add(s)
        bins[n]["c"].add(c)
        out[i] = n
    return out


def test_best_fit_as_naive():
    r = random.Random(1)
    for _ in range(30):
        items = [(r.randint(0, 50), r.choice([None, "a", "b", "c", "d"]), r.choice([None, 1, 2, 3, 4, 5, 6])) for _ in range(r.randint(1, 80))]
        assert best_fit(items, 60) == naive(items, 60)


def test_rows_of_every_kind(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, 90, 250])) + f" {i % 50}", r.choice(["hot", "hot", "a", "b", None])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \t", "b"), (None, "x y", "a"), (3, rows[3][1], rows[3][2]), (1003, "w " * 5000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 as bin", "7 as size")
    got = pack_documents(docs, capacity=100, group=150).collect()
    used, sources, copies = {}, {}, {}
    by_doc = {}
    for x in got:
        key = (x["pack_group"], x["bin"])
        used[key] = used.get(key, 0) + x["size"]
        by_doc.setdefault(x["doc_id"], []).append(x)
    assert all(v <= 100 for v in used.values()) and all(used[x["pack_group"], x["bin"]] == x["bin_used"] for x in got)
    text = {d: (t, s) for d, t, s in rows}
    for x in got:
        t, s = text[x["doc_id"]]
        key = (x["pack_group"], x["bin"])
        if s is not None:
            sources.setdefault(key, []).append(s)
        if t is not None:
            copies.setdefault(key, []).append(t)
    assert all(len(v) == len(set(v)) for v in sources.values()) and all(len(v) == len(set(v)) for v in copies.values())
    for d, pieces in by_doc.items():
        n = len((text[d][0] or "").split())
        k = 2 if d == 3 else 1
        assert sum(p["size"] for p in pieces) == k * n
        if k == 1:
            assert [p["first"] for p in sorted(pieces, key=lambda p: p["piece"])] == list(range(0, max(1, n), 100))


def test_empty_and_without_source(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    assert pack_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 1
    assert [r[0] for r in spark.createDataFrame([(" a  b\n",), ("",), (None,), ("x",)], "text string").select(word_count()).collect()] == [2, 0, 0, 1]


def test_bins_hold_the_words_of_their_pieces(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(r.choice([0, 1, 7, 40, 130]))), r.choice(["a", "b", "c"])) for i in range(80)]
    rows += [(5, "other text of five", "a"), (None, "no id", "b"), (900, None, "c"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    packed = pack_documents(docs, capacity=50, group=40)
    pieces = {}
    for x in packed.collect():
        pieces.setdefault((x["pack_group"], x["bin"]), []).append(x)
    got = {(x["pack_group"], x["bin"]): x for x in packed_texts(docs, packed).collect()}
    text = {(d, w[0]): w for d, t, _ in rows if (w := (t or "").split())}
    for key, ps in pieces.items():
        ps = sorted((p for p in ps if p["size"]), key=lambda p: p["offset"])
        at = 0
        for p in ps:
            assert p["offset"] == at
            at += p["size"]
        if ps:
            words = got[key]["text"].split(" ")
            assert len(words) == at <= 50 and got[key]["offsets"] == [p["offset"] for p in ps] and got[key]["doc_ids"] == [p["doc_id"] for p in ps]
            for p in ps:
                own = words[p["offset"] : p["offset"] + p["size"]]
                assert any(w[p["first"] : p["first"] + p["size"]] == own for (d, _), w in text.items() if d == p["doc_id"])


def test_unlike_rows_of_one_id_are_dealt_to_many_groups(spark):
    docs = spark.createDataFrame([(1, f"text {i}", None) for i in range(400)] + [(None, f"null {i}", None) for i in range(400)], "doc_id long, text string, source string")
    got = pack_documents(docs, capacity=50, group=100)
    assert max(x["count"] for x in got.groupBy("pack_group").count().collect()) < 200
