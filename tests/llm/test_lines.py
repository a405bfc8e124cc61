import random

from panelkit.llm.lines import RUN, dedup_units


def brute(rows, least=RUN):
    """By a walk over all units in order of (doc_id, null last; place)."""
    import re

    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        found = [m for m in re.finditer("[^.!?\n]+[.!?\n]*|[.!?\n]+", text or "")]
        full = [m for m in found if m.group().split()]
        again = []
        for m in full:
            w = " ".join(m.group().lower().split())
            again.append(w in seen)
            seen.add(w)
        cut, i = set(), 0
        while i < len(full):
            j = i
            while j < len(full) and again[j]:
                j += 1
            if sum(len(m.group().split()) for m in full[i:j]) >= least:
                cut |= {m.span() for m in full[i:j]}
            i = max(j, i + 1)
        out[doc_id] = ("".join(m.group() for m in found if m.span() not in cut) if text is not None else None, sorted(cut))
    return out


def test_as_brute_force(spark):
    r = random.Random(1)
    pool = [" ".join(r.choice(["a", "bé", "c", "Dd", "eee"]) for _ in range(r.randint(1, 12))) for _ in range(40)]
    rows = [(i, "".join((r.choice(pool) if r.random() < 0.8 else f"own {i} {r.random()}") + r.choice([". ", "! ", "\n", "?? ", "\n\n", ". \n . "]) for _ in range(r.randint(0, 12)))) for i in range(80)]
    rows += [(1000, None), (1001, ""), (1002, "...\n\n"), (1003, "no mark at the end of this one"), (None, rows[3][1] + rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'keep' as removed", "'d' as d1", "1 as id", "2 as t")
    for least in (1, 8, RUN):
        got = dedup_units(docs, run=least)
        assert got.columns == ["doc_id", "text", "d1", "id", "t", "removed"]
        want = brute(rows, least)
        for x in got.collect():
            text, cuts = want[x["doc_id"]]
            assert x["text"] == text and [(c["first"], c["last"]) for c in x["removed"]] == cuts


def test_passage_inside_a_line_goes(spark):
    passage = " ".join(f"This is sentence number {i} of the shared passage." for i in range(12))
    docs = spark.createDataFrame([(1, "Own words first " + passage + " and an end"), (2, "Quite other words come here " + passage + " then more"), (3, "Clean text without any copy of that.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup_units(docs).collect()}
    assert got[1]["removed"] == [] and got[3]["removed"] == []
    assert "sentence number 5" not in got[2]["text"] and "Quite other words" in got[2]["text"]


def test_repeated_ids_null_ids_and_empty(spark):
    t = "one two three four five six seven. eight nine ten eleven twelve thirteen fourteen fifteen sixteen."
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in dedup_units(docs).collect()) == [(0, ""), (1, t), (1, t), (2, "")]
    assert dedup_units(docs, keep_empty=False).count() == 2
    assert dedup_units(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(0, "one two three four five six seven."), (1, "alpha beta gamma delta epsilon. zeta."), (1, "short. one two three four five six seven. tail text here.")]
    got = sorted(r["text"] for r in dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), run=5).collect())
    assert got == ["alpha beta gamma delta epsilon. zeta.", rows[0][1], "short. tail text here."]


def test_chance_repeats_stay(spark):
    docs = spark.createDataFrame([(1, "It rained on the day before. Nobody came."), (2, "Nobody came. It was a fine day. It rained on the day before.")], "doc_id long, text string")
    assert all(r["removed"] == [] for r in dedup_units(docs).collect())
    assert [r["text"] for r in dedup_units(docs, run=1).orderBy("doc_id").collect()][1] == " It was a fine day."


def test_lines(spark):
    docs = spark.createDataFrame([(1, "All rights reserved. Ask first.\nOwn text"), (2, "Other text\n\nALL rights  reserved. Ask first.\nend")], "doc_id long, text string")
    assert [r["text"] for r in dedup_units(docs, "line", run=4).orderBy("doc_id").collect()] == ["All rights reserved. Ask first.\nOwn text", "Other text\n\nend"]


def test_long_text(spark):
    t = "".join(f"line {i} has a number of words\n" for i in range(20000))
    got = {r["doc_id"]: r for r in dedup_units(spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string")).collect()}
    assert got[1]["text"] == t and got[2]["text"] == "" and len(got[2]["removed"]) == 20000


def test_runs_of_short_units_go_and_their_first_place_stays(spark):
    short = "Yes, sir. No. Quite so!\nAll rights\nTerms of use\nGo home. To be sure of it. Once more then. "
    han = "今天天气非常好我们一起去公园散步玩。然后我们回家吃晚饭看电视。明天再见。"
    docs = spark.createDataFrame(
        [(1, "One opening of its own here. " + short + "An end that nobody else has got."), (2, "Another start with other words. Hm. " + short + "And here it ends in another way."), (3, "Yes, sir. Something quite different comes after that one."), (4, han + "这是第一篇文章的结尾部分内容。"), (5, "另外一篇文章有不同的开头内容。" + han), (6, "b b. " * 9)],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: r["text"] for r in dedup_units(docs, "passage").collect()}
    assert got[1].count("Quite so!") == 1 and got[2].strip() == "Another start with other words. Hm.  And here it ends in another way.".replace("  ", " ")
    assert got[3].startswith("Yes, sir. Something") and got[4].startswith(han) and got[5] == "另外一篇文章有不同的开头内容。"
    assert got[6].split() == ["b", "b."]


def test_passages_without_marks_go(spark):
    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randrange(9999)}" for _ in range(n))
    passage = words(200)
    rows = [(1, words(30) + " " + passage + " " + words(30)), (2, words(30) + " " + passage + " " + words(30))]
    got = {x["doc_id"]: x["text"] for x in dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), "passage").collect()}
    assert got[1] == rows[0][1] and len(set(got[2].split()) & set(passage.split())) < 50


def brute_both(rows, least=RUN):
    """Lines that an earlier line equals go; then runs of repeated sentences in the others."""
    import re

    lines_seen, seen, out = set(), set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        cuts, sentences = [], []
        for m in re.finditer("[^\n]+\n*|\n+", text or ""):
            key = " ".join(m.group().lower().split())
            if key and key in lines_seen:
                cuts.append(m.span())
            lines_seen |= {key} - {""}
            for s in re.finditer("[^.!?\n]+[.!?]*\n*|[.!?]+\n*|\n+", m.group()):
                w = " ".join(s.group().lower().split())
                if w:
                    sentences.append((m.start() + s.start(), m.start() + s.end(), len(w.split()), w in seen))
                    seen.add(w)
        i = 0
        while i < len(sentences):
            j = i
            while j < len(sentences) and sentences[j][3]:
                j += 1
            if sum(s[2] for s in sentences[i:j]) >= least:
                cuts += [s[:2] for s in sentences[i:j] if not any(a <= s[0] < b for a, b in cuts)]
            i = max(j, i + 1)
        cuts.sort()
        kept = text and "".join(ch for i, ch in enumerate(text) if not any(a <= i < b for a, b in cuts))
        out[doc_id] = (kept, cuts)
    return out


def test_lines_and_runs_as_brute_force(spark):
    r = random.Random(2)
    pool = [" ".join(r.choice(["a", "bé", "c", "Dd", "e.e"]) for _ in range(r.randint(1, 9))) for _ in range(30)]
    rows = [(i, "".join((r.choice(pool) if r.random() < 0.8 else f"own {i} {r.random()}") + r.choice([". ", "! ", "\n", "?? ", "\n\n", ". \n . ", ".\n!"]) for _ in range(r.randint(0, 14)))) for i in range(80)]
    rows += [(1000, None), (1001, ""), (1002, "...\n\n"), (1003, "\n\n \n"), (None, rows[3][1] + rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'keep' as at")
    for least in (1, 8, RUN):
        want = brute_both(rows, least)
        for x in dedup_units(docs, "both", run=least).collect():
            text, cuts = want[x["doc_id"]]
            assert x["text"] == text and [(c["first"], c["last"]) for c in x["removed"]] == cuts and x["at"] == "keep"


def test_short_lines_go_from_all_but_the_first(spark):
    line = "The committee met on Tuesday to review ten papers."
    docs = spark.createDataFrame([(4, f"{line}\nfour"), (2, f"Second.\n{line}"), (3, f"{line} But this line goes on.\nthree"), (5, f"five\n\n  {line.upper()}\nend")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], [tuple(c) for c in r["removed"]]) for r in dedup_units(docs, "both").collect()}
    assert got[2] == (f"Second.\n{line}", []) and got[3][1] == []
    assert got[4] == ("four", [(0, len(line) + 1)]) and got[5] == ("five\n\nend", [(6, 6 + len(line) + 3)])


def test_a_passage_inside_lines_goes_beside_lines(spark):
    passage = " ".join(f"This is sentence number {i} of the shared passage." for i in range(12))
    docs = spark.createDataFrame([(1, "Own words first. " + passage + " And an end.\nThe same line."), (2, "Quite other words. " + passage + " Then more.\nThe same line.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup_units(docs, "both").collect()}
    assert got[1]["removed"] == [] and got[2]["text"] == "Quite other words. Then more.\n" and len(got[2]["removed"]) == 13
