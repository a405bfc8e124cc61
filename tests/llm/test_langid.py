import random
import zlib

import numpy as np
import pytest
from panelkit.llm import langid
from panelkit.llm.langid import automaton, build, drop_unidentified, folded, identify_languages, predict


def naive_phrases(text, sample):
    """Each phrase is the longest prefix of the rest that occurs in the sample, at least one character."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i, n = j, n + 1
    return n


@pytest.mark.parametrize("piece", [1, 7, 256])
def test_phrases_as_naive_search(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "LANES", 16)
    r = random.Random(1)
    words = lambda k: " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(k))
    samples = {"x": words(60), "y": words(60).replace("a", "e"), "z": ("ab" * 9 + " ") * 9}
    model = build(samples)
    texts = [words(r.choice([1, 3, 200])) + r.choice(["", "é", " qé é q"]) for _ in range(20)] + [samples["x"] * 3, "", "z", "ab" * 300, words(2000)]
    points, n = folded(texts)
    got = model.phrases(points, n)
    assert got.tolist() == [[naive_phrases(t, samples[k].strip()) for k in model.languages] for t in texts]


def test_automaton_holds_all_substrings_and_no_others():
    r = random.Random(4)
    s = [r.randrange(2, 7) for _ in range(200)]
    a = automaton(s, 7)
    inside = {tuple(s[i:j]) for i in range(200) for j in range(i + 1, min(201, i + 9))}
    for _ in range(3000):
        w = [r.randrange(2, 7) for _ in range(r.randint(1, 8))]
        state, held = np.zeros(1, np.int32), True
        for i, c in enumerate(w):
            state, new = a.step(state, np.array([c]))
            held &= bool(new[0]) == (i == 0)
        assert held == (tuple(w) in inside or len(w) == 1)


def test_many_labels_and_many_letters():
    r = random.Random(6)
    kinds = {f"l{k:03d}": [chr(0x4E00 + 97 * k + i) for i in range(90)] if k % 2 else ["".join(r.choice("abcdefghijkl") for _ in range(3)) for _ in range(6)] for k in range(90)}
    text = lambda k, n: " ".join("".join(r.choice(kinds[k]) for _ in range(3)) for _ in range(n))
    model = build({k: text(k, 200) for k in kinds})
    assert len(model.languages) == 90 and len(model.alphabet) > 3000
    assert predict(model, [text(k, 40) for k in kinds])[0] == sorted(kinds)


def test_texts_in_no_learned_language_are_rejected():
    r = random.Random(7)
    word = lambda parts: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    kinds = {"en": "th er on an re he in ed nd ha".split(), "fr": "é que ou le ai eau la ment tion".split()}
    model = build({k: " ".join(word(v) for _ in range(3000)) for k, v in kinds.items()})
    own = [" ".join(word(v) for _ in range(n)) for v in kinds.values() for n in (1, 5, 60, 900)]
    other = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)), "Это текст на другом языке, и он достаточно длинный."]
    assert all(predict(model, own)[2]) and not any(predict(model, other)[2])
    assert predict(model, ["", "12"])[2] == [False, False]


def test_folding():
    points, n = folded(["  Ab, c!!", "", "12", "É x y ", "!z"])
    assert n.tolist() == [4, 0, 0, 5, 1] and "".join(chr(c) if c else " " for c in points) == "ab cé x yz"


def corpus():
    r = random.Random(2)
    kinds = {"en": "th er on an re he in ed nd ha".split(), "fr": "é que ou le ai eau la ment tion".split(), "de": "ein ich sch und er ung ge".split()}
    return [(i, " ".join("".join(r.choice(kinds[k]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 80))), k) for i in range(300) for k in [r.choice(list(kinds))]]


def test_held_out_accuracy_and_rows_of_every_kind(spark):
    rows = corpus()
    extra = [(None, "the and one", "en"), (900, None, "en"), (901, "", "fr"), (902, "12 !!", None), (903, "日本語", None), (904, "ein " * 30000, None), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").selectExpr("*", "'q' as lang_pred", "2 as score")
    got = identify_languages(docs).collect()
    assert len(got) == len(rows) + 7
    truth = {d: k for d, _, k in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902)) and by[903]["lang_pred"] != "und" and by[904]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = drop_unidentified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {900, 901, 902}


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "1", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in identify_languages(docs).collect()} == {"und"}
    assert [r["doc_id"] for r in drop_unidentified(docs).collect()] == [1]
    assert identify_languages(docs.limit(0)).collect() == []
    assert predict(build({}), ["a"]) == (["und"], [0.0], [True]) and np.array_equal(folded([""])[1], [0])
