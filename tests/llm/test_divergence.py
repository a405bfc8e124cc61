import random
import re
from collections import Counter, defaultdict

import pytest
from panelkit.llm import divergence
from panelkit.llm.divergence import document_terms, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"
RUN = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms_of(text):
    return Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in RUN.findall(text or ""))


def brute(rows, min_docs, top=50):
    docs = [(lang or "", source or "", terms_of(text)) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = [t for t in df if df[t] >= min_docs]
        n = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                n[d[1]].update({t: d[2][t] for t in kept if t in d[2]})
        total = sum(n.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s in n:
            pairs = [(-sum(abs(p(n[s], t) - p(n[o], t)) for t in kept), o) for o in n if o != s]
            own = [(-(p(n[s], t) - p(total, t)), t.encode()) for t in n[s] if p(n[s], t) > p(total, t)]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())))}
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(own)[:top])}
    return out


def result(df):
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]


def corpus(seed=3):
    r = random.Random(seed)
    words = ["the", "The", "été", "Été", "x1y", "naïve", "straße", "日本", "a_b", " nb", "z" * 40, "Ω", "ω"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(160):
        text = "".join(r.choice(words[: 13 if r.random() < 0.3 else None]) + r.choice([" ", "\n", ", ", "-", "\t", "\x7f", "@"]) for _ in range(r.randrange(60)))
        rows.append((i, text, r.choice(["en", "en", "fr", None]), r.choice(["a", "a", "a", "b", "é", "c", None])))
    rows += [rows[0]] * 7 + [(None, None, None, None), (5, "", "de", "only"), (6, "!!! 123", "it", "p"), (7, None, "it", "q"), (8, "the The THE", "en", "lone")]
    return rows


def in_task(held, piece):
    """The fold with these sizes, set where the task runs."""

    def run(batches):
        from panelkit.llm import divergence as d

        before, d.HELD, d.PIECE = (d.HELD, d.PIECE), held, piece
        try:
            yield from d._folded(batches)
        finally:
            d.HELD, d.PIECE = before

    return run


@pytest.mark.parametrize(("held", "piece", "block"), [(400_000, 1 << 20, 1024), (20, 7, 4)])
def test_as_brute_force(spark, monkeypatch, held, piece, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = corpus()
    monkeypatch.setattr(divergence, "_folded", in_task(held, piece))
    got = result(source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), min_docs=8))
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 8)
    assert any(x[0] == "it" and x[2] == "pair" and x[4] == 0 for x in got)
    assert not any(x[0] == "de" for x in got)


def test_long_texts_are_split_at_separators(monkeypatch):
    text = ("Zug " * 400 + "ÉÀé-x9Y\n") * 5 + "q" * 3000
    want = {t.encode(): n for t, n in terms_of(text).items()}
    for piece in (1, 5, 64, 10**6):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert document_terms(text.encode()) == want


def test_empty_tables_and_clashing_names(spark):
    assert result(source_divergence(spark.createDataFrame([], SCHEMA))) == []
    rows = corpus(4)
    wide = spark.createDataFrame([(*r, 1, 2.0, "x", True) for r in rows], SCHEMA + ", n int, p double, term string, first boolean")
    assert set(result(source_divergence(wide, min_docs=8, top=3))) == brute(rows, 8, 3)
