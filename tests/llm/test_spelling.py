import random
import re
import zlib
from collections import Counter

import pytest
from panelkit.llm import spelling
from panelkit.llm.spelling import affected, decompose, rare_grams, spelling_groups

SCHEMA = "doc_id long, text string"
RUN = re.compile("[A-Za-z\\u00C0-\\u00FF]+")


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in map(lowered, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    close = {w: [v for v in n if near(v, w)] for w in n}
    best = {w: min(c, key=lambda v: (-n[v], v)) for w, c in close.items() if c}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None))
    return out


def corpus(seed=1, alphabet="abé"):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(5, 9))) for _ in range(60)]
    pool = [w for w in base for _ in range(r.choice((1, 2, 8, 60)))]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(60):
            w = r.choice(pool)
            if r.random() < 0.3:
                k = r.randrange(len(w) + 1)
                w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice(alphabet) + w[k:], w[:k] + r.choice(alphabet) + w[k + 1 :]))
            text += (w.upper() if r.random() < 0.1 else w) + r.choice((" ", "\n", "-", "1", "’", "日", "."))
        rows.append((i, text))
    return rows + [rows[3]] * 4 + [(None, rows[5][1]), (None, None), (-7, ""), (900, "×÷ÀÿÝý " * 8), (901, "Ā×÷Àÿ Ýý× " * 8)]


def result(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


@pytest.mark.parametrize(("alphabet", "frequent"), [("abé", 3), ("abé", 200), ("abcdefgh", 2)])
def test_as_brute_force(spark, monkeypatch, alphabet, frequent):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    rows = corpus(2, alphabet)
    got = result(spelling_groups(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_chains_end_at_the_last_form(spark):
    n = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 130, "abcdefghi": 700, "abcdefghij": 4000}
    text = " ".join(w for w, c in n.items() for _ in range(c))
    rows = [(i, text) for i in range(1)]
    got = {r[0]: r for r in result(spelling_groups(spark.createDataFrame(rows, SCHEMA)))}
    assert set(got.values()) == brute(rows)
    assert got["abcdef"][2] == "abcdefghij" and got["abcdefghij"][1] is None


def test_an_edit_takes_no_more_grams_than_the_bound():
    r = random.Random(5)
    for _ in range(3000):
        alphabet = "ab" if r.random() < 0.5 else "abcde"
        text = lambda k: "".join(r.choice(alphabet) for _ in range(k))  # noqa: B023, E731
        frequent = {}
        for g in (text(r.choice((2, 3, 4))) for _ in range(r.randrange(40))):
            frequent |= {g[:k]: 1 for k in range(2, len(g) + 1)}  # what begins a frequent gram is frequent
        for e in range(3):
            frequent |= {f"^{text(e)}"[:3]: 1, f"{text(e)}$"[-3:]: 1}
        frequent = {g: 1 for g in frequent if len(g) > 1 and all(g[:k] in frequent for k in range(2, len(g)))}
        w = text(r.randrange(6, 12))
        k = r.randrange(len(w) + 1)
        v = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice(alphabet) + w[k:], w[:k] + r.choice(alphabet) + w[k + 1 :]))
        if len(v) < 6 or v == w:
            continue
        grams = {x: Counter(f"^{x}$"[p:q] for p, q in decompose(f"^{x}$", frequent)) for x in (w, v)}
        common = sum((grams[w] & grams[v]).values())
        for x in (w, v):
            bound = affected(f"^{x}$", decompose(f"^{x}$", frequent), frequent)
            assert 1 <= sum(grams[x].values()) - bound <= common
        shift = len(v) - len(w)
        assert any(g == h and q - p in (0, shift) for g, p in rare_grams(w, frequent) for h, q in rare_grams(v, frequent))


def test_whole_texts_in_pieces_and_empty_tables(spark, monkeypatch):
    from panelkit.llm import divergence

    text = ("Straße naïveté " * 300 + "wörterbuch,") * 3
    whole = Counter()
    for w, n in spelling.document_words(3, text.encode()):
        whole[w] += n
    monkeypatch.setattr(divergence, "PIECE", 11)
    parts = Counter()
    for w, n in spelling.document_words(3, text.encode()):
        parts[w] += n
    assert parts == whole and sum(whole.values()) == 1803
    assert result(spelling_groups(spark.createDataFrame([], SCHEMA))) == []
    rows = corpus(6)
    wide = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", word string, n int, at int")
    assert set(result(spelling_groups(wide))) == brute(rows)
