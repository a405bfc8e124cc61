import random

import corpus_pipeline
import pytest
from panelkit.llm import queries as Q

from .test_decontam import brute as brute_tiles
from .test_decontam import words_of
from .test_lines import brute as brute_units


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("the and one red sea bad dog cat".split()) for _ in range(r.randint(1, 3)))
    text = lambda n: ". ".join(" ".join(word() for _ in range(12)) for _ in range(n)) + "."
    item = text(3)
    rows = [(i, text(12), "en", f"s{i % 3}") for i in range(40)]
    passage = text(6)
    rows[5] = (5, rows[5][1] + " " + passage, "en", "s1")
    rows[9] = (9, rows[9][1] + " " + passage, "en", "s2")
    rows[7] = (7, rows[7][1] + " " + item + " end", "en", "s1")
    near = rows[3][1].split()
    near[20] = "zzz"
    rows += [(100, rows[2][1], "en", "s0"), (101, " ".join(near), "en", "s0"), (102, "123 ...", "en", "s0"), (103, None, None, None)]
    return rows, item, passage


def test_stages(spark, tmp_path):
    rows, item, passage = corpus()
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars", "'x' as removed")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "repeats", "leaks", "packing"]
    d, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in d.collect()}
    first = {r[0] for r in rows}
    assert first - set(seen["language"]) == {102, 103}
    assert set(seen["language"]) - set(seen["near_copies"]) == {100, 101}
    assert set(seen["repeats"]) == set(seen["near_copies"])
    inner = passage.split(". ")[2]
    assert inner in seen["repeats"][5]["text"] and inner not in seen["repeats"][9]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["repeats"].values())
    assert all(seen["repeats"][i]["text"] == t for i, t, _, _ in rows[:5])
    assert set(seen["repeats"]) - set(seen["leaks"]) == {7}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(seen["leaks"]) and all(r["bin_used"] <= 2048 for r in got)


def brute(rows, items):
    """The texts that reach the last stage, stage by stage in plain Python."""
    kept = {d: t for d, t, _, _ in rows if t and any(map(str.isalpha, t))}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in kept.items() for w in [t.lower().split()]}
    least = {d: d for d in kept}
    for _ in range(5):
        for a in kept:
            for b in kept:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    kept = {d: t for d, t in kept.items() if least[d] == d}
    cut = brute_units([(d, t) for d, t in kept.items()])
    kept = {d: cut[d][0] for d in kept}

    def leaks(t):
        dw = words_of(t)
        for x in items:
            iw = words_of(x)
            number = {w: k for k, w in enumerate(dict.fromkeys(iw))}
            if sum(n for _, _, n in brute_tiles([number.get(w, -1) for w in dw], [number[w] for w in iw], 5)) >= 0.5 * len(iw):
                return True
        return False

    return {d: t for d, t in kept.items() if not leaks(t)}


def test_run_as_brute_force(spark, tmp_path):
    rows, item, _ = corpus()
    w = item.split()
    rows.append((110, rows[11][1] + " " + " ".join(w[18:] + w[:18]), "en", "s2"))  # the item, its halves exchanged
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    want = brute(rows, [item])
    got = {}
    for x in corpus_pipeline.run(spark, sf).collect():
        got[x["doc_id"]] = got.get(x["doc_id"], 0) + x["size"]
    assert got == {d: len(t.split()) for d, t in want.items()}


def test_rows_of_every_kind_go_through_all_stages(spark, tmp_path):
    rows, item, _ = corpus()
    r = random.Random(3)
    long = ". ".join(" ".join(r.choice(["the", "and", "one", "red", "sea"]) + str(r.randrange(9999)) for _ in range(9)) for _ in range(4000))
    rows += [rows[4], rows[4], (None, rows[1][1], "en", None), (None, "an own text of a row without an id, and some more words", None, "s1"), (200, "", "en", "s1"), (201, long, "en", "s2"), (6, "quite another text for the id of six, with words of its own", "en", "s1"), (202, item, None, None)]
    sf = str(tmp_path)
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string"
    extra = ["'a' as removed", "1 as size", "'b' as t", "2 as id", "3 as h", "4 as bin", "5 as node", "'c' as component_id", "cast(length(text) as long) as n_chars"]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema).selectExpr("*", *extra)
        docs.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
        d = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, sf)
            assert d.columns == docs.columns and d.count() <= len(some), name
        got = corpus_pipeline.run(spark, sf).collect()
        ids = [x["doc_id"] for x in got]
        if some:
            assert 200 not in ids and 7 not in ids and 201 in ids and None in ids and ids.count(4) == 3
            assert [x["size"] for x in got if x["doc_id"] == 202] == [0]  # its text stood earlier, in 7
            assert sum(x["size"] for x in got if x["doc_id"] == 201) == len(long.split())
        else:
            assert got == []


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries_on_given_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    got = Q.queries()[name](spark, sf)
    table, key = ("pages", "page_id") if name.startswith("op2_") else ("documents", "doc_id")
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    rows = got.collect()
    if name.startswith("op7_"):
        assert all(r["coverage"] >= 0.5 for r in rows)
    elif name.startswith("op6_"):
        assert len({r["doc_id"] for r in rows}) == n
    elif name.startswith("op12_"):  # rows of groups and items, not of documents
        groups = {}
        for r in rows:
            groups.setdefault((r["lang"], r["source"], r["part"]), []).append((r["rank"], r["item"], r["value"]))
        assert all([x[0] for x in sorted(g)] == list(range(1, len(g) + 1)) and len({x[1] for x in g}) == len(g) for g in groups.values())
        assert all([x[2] for x in sorted(g)] == sorted((x[2] for x in g), reverse=True) for g in groups.values())
    elif name.startswith("op13_"):  # rows of words
        assert len({r["word"] for r in rows}) == len(rows) and all(len(r["word"]) >= 6 and r["n"] >= 5 for r in rows)
    else:
        assert len(rows) == n and len({r[key] for r in rows}) == n
