import random

import numpy as np
import xxhash
from panelkit.llm import golay
from panelkit.llm.components import components
from panelkit.llm.simhash import drop_near_copies, near_components, simhash_documents, wide


def test_golay_is_perfect():
    r = np.random.default_rng(1)
    w = r.integers(0, 1 << 23, 20000).astype(np.int32)
    assert np.bitwise_count((w ^ (w ^ golay._LEAD[golay.syndrome(w)])).astype(np.uint32)).max() <= 3
    assert (golay.syndrome(w ^ golay._LEAD[golay.syndrome(w)]) == 0).all()


def test_words_at_distance_two_share_an_index():
    r = np.random.default_rng(2)
    w = r.integers(0, 1 << 23, 3000).astype(np.int32)
    for _ in range(5):
        a, b = r.integers(0, 23, (2, 3000))
        v = (w ^ (1 << a) ^ (1 << b)).astype(np.int32)
        assert all(set(x) & set(y) for x, y in zip(golay.nearby(w).tolist(), golay.nearby(v).tolist(), strict=True))
        one = (w ^ (1 << a)).astype(np.int32)
        assert all(set(x) & set(y) for x, y in zip(golay.one_apart_keys(w).tolist(), golay.one_apart_keys(one).tolist(), strict=True))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_print(text):
    w = [x for x in (text or "").encode().lower().split()]
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) * 2 > len(s) for b in range(64)] if s else [0] * 64
    return sum(1 << i for i, b in enumerate(bits) if b)


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return prints, [min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))]


def corpus(n=60, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 40, 200]))]
        rows.append((10 * i, " ".join(base)))
        for c in range(r.choice([0, 0, 1, 5])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append((10 * i + c + 1, " ".join(copy)))
    return rows + [(5000, ""), (5001, None), (5002, " \t\n"), (5003, "Word"), (5004, "word")]


def test_components_as_brute_force_with_hot_keys_split(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fingerprint", "1 as component_id")
    prints, want = brute_components(rows)
    for cell in (512, 2):
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_documents(docs, cell).collect()}
        assert got == {d: (f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, want, strict=True)}


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "zz yy xx ww"), (2, "q r s t u v")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in near_components(docs).select("doc_id", "component_id").collect() if r["component_id"] is not None)
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 2), (True, None, 1)]
    assert simhash_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_copies_go(spark):
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(5000)]
    rows = []
    for i in range(12):
        base = [r.choice(vocab) for _ in range(400)]
        rows.append((100 * i, " ".join(base), "s"))
        for c in range(1, 8):
            copy = list(base)
            for _ in range(4):  # 20 of 396 shingles change: resemblance about 0.9
                copy[r.randrange(400)] = r.choice(vocab)
            rows.append((100 * i + c, " ".join(copy), "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, certainty string")
    got = drop_near_copies(docs)
    assert sorted(x["doc_id"] for x in got.collect()) == [100 * i for i in range(12)]
    assert got.columns == docs.columns and wide().lanes == 4


def test_only_exact_near_copies_are_linked(spark):
    r = random.Random(8)
    vocab = ["w%d" % i for i in range(5000)]
    sets, rows = {}, []
    for i in range(60):
        base = [r.choice(vocab) for _ in range(300)]
        for c in range(4):
            rows.append((10 * i + c, " ".join(base)))
            for at in r.sample(range(300), r.randint(5, 10)):  # resemblance of one to the next about 0.72 to 0.85
                base[at] = r.choice(vocab)
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and a // 10 == b // 10}
    assert sum(0.8 <= x < 0.85 for x in like.values()) > 20 and sum(0.7 <= x < 0.8 for x in like.values()) > 20
    least = {d: d for d in sets}
    for _ in range(4):
        for (a, b), x in like.items():
            if x >= 0.8:
                least[a] = least[b] = min(least[a], least[b])
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string"), wide(), 64)
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == least


def test_a_very_long_text(spark):
    r = random.Random(11)
    long = " ".join(f"w{r.randrange(9000)}" for _ in range(150_000))
    rows = [(1, long), (2, long + " w1"), (3, "a b c d")]
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (f"{brute_print(long):016x}", 1) and got[2][1] == 1 and got[3][1] == 3


def test_a_row_without_an_id_links_others(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(50)}" for _ in range(120)]
    tried = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(120)]
    prints = [brute_print(t) for t in tried]
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    a, b, c = next((a, b, c) for b in range(120) for a in range(120) if near(a, b) for c in range(120) if near(b, c) and not near(a, c))
    rows = [(1, tried[a]), (None, tried[b]), (9, tried[c]), (None, "alone without an id or a link here")]
    for ids in ([1, None, 9, None], [1, None, (1 << 63) - 1, None], [None] * 4):
        got = simhash_documents(spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, rows, strict=True)], "doc_id long, text string")).collect()
        assert len(got) == 4 and {x["fingerprint"]: x["component_id"] for x in got} == {f"{brute_print(t):016x}": ids[0] if i < 3 else None for i, (_, t) in enumerate(rows)}
