import hashlib
import random

import numpy as np
import xxhash
from panelkit.llm.sketch import K, containment, decode, distinct, edited_fingerprints, encode, merge, merged_fingerprints, resemblance, shingle_hashes, sketch


def words(r, n, vocab=2000):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates():
    r = random.Random(1)
    for n, share in ((60, 0.5), (3000, 0.5), (3000, 0.9)):
        a = words(r, n)
        b = " ".join(a.split()[: int(n * share)]) + " " + words(r, n - int(n * share))
        sa, sb = shingles(a), shingles(b)
        j, c = len(sa & sb) / len(sa | sb), len(sa & sb) / len(sa)
        exact = n < K
        assert abs(resemblance(sketch(a), sketch(b)) - j) < (1e-9 if exact and len(sa | sb) < K else 0.2)
        assert abs(containment(sketch(a), sketch(b)) - c) < 0.25
        assert abs(distinct(sketch(a)) / len(sa) - 1) < (1e-9 if len(sa) < K else 0.35)


def test_merging_parts_gives_the_whole():
    r = random.Random(2)
    h = [shingle_hashes(words(r, 400)) >> np.uint64(16) for _ in range(5)]
    parts = [np.unique(x)[:K] for x in h]
    whole = parts[0]
    for p in parts[1:]:
        whole = merge(whole, p)
    assert (whole == np.unique(np.concatenate(h))[:K]).all()


def test_text_forms():
    assert encode(sketch("A b c d e f")) == encode(sketch("a B  c\td e\nf")) and (decode(encode(sketch("a b"))) == sketch("a b")).all()
    assert len(sketch("")) == 0 and len(sketch("x")) == 1 and resemblance(sketch(""), sketch("")) == 1.0 and resemblance(sketch(""), sketch("a")) == 0.0
    rep = "a b c d e " * 3000
    assert len(sketch(rep)) == len(shingles(rep)) == 5


def brute_sketch(text, k=96):
    """The definition in whole numbers: nothing of the module is used."""
    m = (1 << 64) - 1
    w = [xxhash.xxh64_intdigest(x, 7) for x in text.encode().lower().split()]
    out = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        part = w[i : i + 5]
        h = len(part)
        for x in part:
            h = (h * 0x9E3779B97F4A7C15 + x) & m
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
        out.add((h ^ h >> 31) >> 16)
    return sorted(out)[:k]


def brute_like(a, b, k=96):
    union = sorted({*a, *b})[:k]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    text = lambda s: "".join(f"{x:012x}" for x in s)
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = map(brute_sketch, (t, e, nxt))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), text(a), text(b), brute_like(a, b), brute_like(a, c)))
    return out


def test_merged_by_group(spark):
    r = random.Random(6)
    rows = [(i % 3 if i % 7 else None, words(r, r.choice([0, 3, 200]))) for i in range(60)]
    prints = spark.createDataFrame([(g, encode(sketch(t))) for g, t in rows] + [(1, None)], "g long, fingerprint string").repartition(4)
    got = {x["g"]: x["fingerprint"] for x in merged_fingerprints(prints, "g").collect()}
    for g in (None, 0, 1, 2):
        whole = sorted({h for k, t in rows if k == g for h in brute_sketch(t, 10**9)})[:K]
        assert got[g] == "".join(f"{x:012x}" for x in whole)
    assert merged_fingerprints(prints.limit(0), "g").collect() == []


def test_as_brute_force(spark):
    r = random.Random(3)
    rows = [(r.randrange(10**6), words(r, r.choice([0, 1, 3, 50, 300]))) for _ in range(120)] + [(-5, None), (10**7, ""), (4, "é" * 9), (3, "x " * 60000), (77, "same same"), (77, "same same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'p' as part", "'c' as copy", "'f' as fingerprint")
    for parts in (1, 5):
        got = edited_fingerprints(docs, parts).drop("distinct_shingles", "contained_in_next").collect()
        assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_null_ids_one_row_and_empty(spark):
    rows = [(None, "b c"), (1, "d e f g"), (2, "h")]
    assert sorted(map(repr, map(tuple, edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 3).drop("distinct_shingles", "contained_in_next").collect()))) == sorted(map(repr, brute(rows)))
    assert [tuple(x) for x in edited_fingerprints(spark.createDataFrame(rows[1:2], "doc_id long, text string")).drop("distinct_shingles", "contained_in_next").collect()] == brute(rows[1:2])
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
