import random
import zlib
from itertools import product

import numpy as np
from panelkit.llm.common import ROW_BYTES, id_cuts, id_part
from panelkit.llm.huffman import BLOCK, CHECK, Decoder, Words, canonical, code_lengths, pack, read_tokens, token_round_trip, tokenizer_path, write_tokens
from pyspark.sql import functions as F


def test_lengths_are_the_best_within_the_limit():
    r = random.Random(1)
    for _ in range(20):
        counts = np.array([r.randint(0, 40) for _ in range(5)])
        got = code_lengths(counts, 3)
        n = np.flatnonzero(counts)
        if len(n) < 2:
            continue
        best = min(sum(counts[i] * x for i, x in zip(n, ls, strict=True)) for ls in product(range(1, 4), repeat=len(n)) if sum(2.0**-x for x in ls) <= 1)
        assert (counts * got).sum() == best and sum(2.0 ** -got[i] for i in n) <= 1


def test_codes_are_prefix_free_and_canonical():
    counts = np.random.default_rng(1).zipf(1.3, 300) % 1000
    lengths = code_lengths(counts, 12)
    codes = canonical(lengths)
    words = [f"{codes[i]:0{lengths[i]}b}" for i in np.flatnonzero(lengths)]
    assert lengths.max() <= 12 and not any(a != b and b.startswith(a) for a in words for b in words)
    by = sorted(np.flatnonzero(lengths), key=lambda i: (lengths[i], i))
    assert [int(codes[i]) << int(12 - lengths[i]) for i in by] == sorted(int(codes[i]) << int(12 - lengths[i]) for i in by)


def test_blocks_come_back_and_checkpoints_stand_alone():
    r = np.random.default_rng(2)
    blocks = [r.zipf(1.5, n).clip(0, 400) for n in (1, 2, CHECK - 1, CHECK, CHECK + 1, 5 * CHECK + 7)]
    counts = np.bincount(np.concatenate(blocks))
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    packed = [(*pack(b, lengths, codes), len(b)) for b in blocks]
    assert all((a == b).all() for a, b in zip(Decoder(lengths).unpack(packed), blocks, strict=True))
    data, marks, n = packed[-1]
    assert (Decoder(lengths).unpack([(data, marks[2:3], CHECK)])[0] == blocks[-1][2 * CHECK : 3 * CHECK]).all()


def library(texts):
    """Ids by an untouched tokenizer of the library."""
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch_fast(texts, add_special_tokens=False)]


def same(texts):
    words, want = Words(tokenizer_path(), False), library(texts)
    for _ in range(2):  # the second time from the table
        got = [np.frombuffer(x, "<u2").tolist() for x in words.encode(texts)]
        assert got == want, next((t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w)


def test_words_give_the_ids_of_whole_texts():
    r = random.Random(3)
    parts = ["The", "Über", "İstanbul", "İ_", "don't", "ﬁne", "a\u0301b", "x2y", "...", "foo,", "BAR!!", "naïve", "ΣΑΣ", "ΑΣ'", " ", "\t", "\x1c", "\x85", "\xa0", "²", "日本", "'s", "<|endoftext|>", "<|EndOfText|>", "_<|startoftext|>", "e-mail", "_x_", "$5.00", "\u200b", "ñ", "\u2001", "K", "ẞ"]
    same(["".join(r.choice(parts) + r.choice([" ", "", "\n"]) for _ in range(r.randint(0, 30))) for _ in range(1500)])


def test_ids_of_random_code_points():
    r = random.Random(5)
    plain = [*range(0xD800), *range(0xE000, 0x110000)]
    point = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(0x250), r.randrange(0x250), r.choice(plain)]))
    same(["".join(point() for _ in range(r.randint(0, 20))) for _ in range(20_000)])
    same([f"a{chr(c)}_ {chr(c)}! B{chr(c)}'" for c in range(0x3100)])


def test_a_document_longer_than_a_block(spark):
    r = random.Random(6)
    long = " ".join(r.choice(["alpha", "beta,", "Gamma", "12", "é!"]) for _ in range(BLOCK))
    rows = [(1, "a b"), (2, long), (3, None), (4, "c")]
    got = sorted(token_round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    at = 0
    for x, ids in zip(got, library([t or "" for _, t in rows]), strict=True):
        raw = np.array([*ids, 1], "<u4")
        assert tuple(x)[1:] == (at, len(raw), zlib.crc32(raw.tobytes()))
        at += len(raw)
    assert got[1]["n_tokens"] > BLOCK


def test_runs_are_of_about_equal_bytes(spark):
    rows = [(i, "x" * (20_000 if i < 400 and i % 10 == 0 else 10)) for i in range(2000)] + [(None, "y"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = id_cuts(docs, 64)
    runs = {x["run"]: x["n"] for x in docs.groupBy(id_part(cuts).alias("run")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).alias("n")).collect()}
    assert 12 < len(runs) <= 80 and max(runs.values()) < 0.12 * sum(runs.values())
    for cuts in ([], [5], list(range(0, 2000, 7))):
        got = docs.select("doc_id", id_part(cuts).alias("p")).collect()
        assert all(x["p"] == (0 if x["doc_id"] is None else sum(c <= x["doc_id"] for c in cuts)) for x in got)


def test_round_trip(spark):
    r = random.Random(4)
    texts = [None, "", " "] + [" ".join("".join(r.choice("abcdeé,.") for _ in range(r.randint(1, 7))) for _ in range(r.choice([1, 20, 3000]))) for _ in range(60)]
    rows = [(11 * i % 63, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as part")
    got = sorted(token_round_trip(docs).collect())
    at, want = 0, library([t or "" for _, t in sorted(rows)])
    for x, (d, _), own in zip(got, sorted(rows), want, strict=True):
        ids = np.array([*own, 1], "<u4")
        assert tuple(x) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_ids_null_and_repeated_ids_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b"), (None, "a"), (1, "a")], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "t"), tokenizer_path())
    got = sorted(read_tokens(spark, str(tmp_path / "t"), ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1] and [r["start"] for r in got] == [0, 2, 4] and all(r["ids"][-1] == 1 for r in got)
    assert token_round_trip(docs.limit(0)).collect() == []
