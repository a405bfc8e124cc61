"""Token ids as canonical, length-limited Huffman code in independent blocks.

A token file is a folder with three Parquet tables:

- ``blocks``: part, block, first (ids before it in its part), doc_ids, counts (ids of each document), checkpoints (bit
  offset of every CHECK-th id), payload (the code bits, highest first). A block holds whole documents.
- ``code``: id, bits. Code words follow from the lengths (canonical: by length, then id).
- ``parts``: part, start (ids of all parts before it).

Parts and blocks are in ascending doc_id order. Every block can be read alone, and inside a block every checkpoint is
a place where decoding can begin; decoding runs over all checkpoints of many blocks at once by table lookup.
"""

from __future__ import annotations

import gc
import os
import re
import string
import unicodedata
import uuid
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RUNS, checkpoint_dir, id_cuts, id_part, shuffle_partitions, written

#: Ids of a block (a longer document is a block of its own), ids between checkpoints, most bits of a code word.
BLOCK, CHECK, MAX_BITS = 1 << 16, 1 << 10, 20
#: Words whose ids a worker remembers; ids that are decoded together.
WORDS_KEPT, DECODED = 900_000, 1 << 21


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """The best code lengths of at most limit bits (package-merge); 0 for ids that do not occur."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(ids)
    if n <= 2:
        out[ids] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit into codes of {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        is_leaf.append(at < n)
        row = both[at]
    taken = 2 * n - 2
    for level in reversed(is_leaf):
        m = int(level[:taken].sum())
        out[order[:m]] += 1
        taken = 2 * (taken - m)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code word of each id that has a length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.int64)
    code = last = 0
    for n in np.unique(lengths[order]):
        these = order[lengths[order] == n]
        code <<= int(n) - last
        codes[these] = code + np.arange(len(these))
        code += len(these)
        last = int(n)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits of the ids, bit offsets of every CHECK-th id)."""
    n = lengths[ids]
    ends = np.cumsum(n)
    at = ends - n
    word, room = at >> 6, 64 - (at & 63) - n
    code = codes[ids].astype(np.uint64)
    out = np.zeros(int(ends[-1] + 63) // 64 + 1, np.uint64)
    head = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[first]] = np.bitwise_or.reduceat(head, first)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], at[::CHECK]


class Decoder:
    """Table-driven: the next MAX_BITS bits look up id and length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = int(lengths.max()) if len(lengths) else 1
        codes = canonical(lengths)
        ids = np.flatnonzero(lengths)
        order = ids[np.argsort(codes[ids] << (self.bits - lengths[ids]))]
        span = 1 << (self.bits - lengths[order])
        fill = (1 << self.bits) - int(span.sum())
        self.entry = np.concatenate([np.repeat(order << 5 | lengths[order], span), np.full(fill, 1)]).astype(np.int64)

    def unpack(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of each block of (payload, checkpoints, number of ids)."""
        data = np.frombuffer(b"".join(p + bytes(4) for p, _, _ in blocks), np.uint8).astype(np.uint32)
        window = np.append(data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:], np.zeros(4, np.uint32)).astype(np.int64)
        base = np.cumsum([0, *(len(p) + 4 for p, _, _ in blocks[:-1])]) * 8
        lanes = np.concatenate([b + c for b, (_, c, _) in zip(base, blocks, strict=True)])
        size = np.concatenate([np.minimum(CHECK, n - CHECK * np.arange(len(c))) for _, c, n in blocks])
        out = np.zeros((int(size.max()), len(lanes)), np.int64)
        at, limit, mask = lanes.astype(np.int64), len(window) * 8 - 8, (1 << self.bits) - 1
        for k in range(len(out)):
            # past its end a lane reads whatever follows; those ids are cut off below
            got = self.entry[window[at >> 3] >> (32 - self.bits - (at & 7)) & mask]
            out[k] = got >> 5
            at = np.minimum(at + (got & 31), limit)
        flat, ids, lane = out.T, [], 0
        for _, c, n in blocks:
            ids.append(flat[lane : lane + len(c)].ravel()[: n if n % CHECK == 0 or len(c) == 1 else None][:n])
            lane += len(c)
        return ids


_MARKS = string.punctuation
#: White space to str.split(), not to the tokenizer.
_OTHER_SPACE = re.compile("[\x1c-\x1f]")
#: Texts of these code points are in NFC, and each of them has one lower-case letter whatever stands beside it: Latin
#: up to U+024F but for U+0130, whose lower case is a letter and a mark.
_SIMPLE = re.compile("[\x00-\u012f\u0131-\u024f]*")
#: Lower-case letters among them, by Python's and by the tokenizer's rules alike.
_LETTERS = re.compile("[a-zªµºß-öø-\u012f\u0131-\u024f]+")


class Words:
    """Ids of words as bytes, remembered in a table of bounded size; equal to the library's ids of the whole text.

    The tokenizer (a word-level BPE) first brings a text into NFC, makes each run of white space one space, lower-cases
    it, and cuts it at white space and where letters meet marks. None of these steps looks across white space: white
    space composes with nothing, and is neither cased nor passed over by the rules of lower case. So the ids of a text
    in NFC are those of its words one after another. Not so for texts that hold an added token (matched in the raw
    text before anything else), that are not in NFC, or that hold U+001C to U+001F: these are encoded whole.

    A word of Latin letters with ASCII marks behind it is cut between the two, so its ids are those of the letters and
    of the marks. Letters that are new are encoded together, with spaces between them, and told apart by the ids that
    end a word; only Latin letters that the library leaves as they are go this way.
    """

    def __init__(self, path: str, wide: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u4" if wide else "<u2"
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of these words; the table keeps them, and drops its newer half to make room (common words came early)."""
        known, marked, letters, other, marks = self.table.get, [], set(), [], set()
        found: dict[str, bytes] = {}
        for w in words:
            stem = w.rstrip(_MARKS)
            if not _LETTERS.fullmatch(stem):
                other.append(w)
            elif len(stem) == len(w):
                letters.add(w)
            else:
                end = w[len(stem) :]
                a, b = known(stem), known(end)
                if a is not None and b is not None:
                    found[w] = a + b
                    continue
                marked.append((w, stem, end))
                if b is None:
                    marks.add(end)
                if a is None:
                    letters.add(stem)
                else:
                    found[stem] = a
        other += marks
        found.update(zip(other, self.whole(other), strict=True))
        new = [x for x in letters if x not in found]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
            if len(ends) == len(part):
                raw, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
                cuts = [0, *(ends * width).tolist()]
                found.update(zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
            else:
                found.update(zip(part, self.whole(part), strict=True))
        for w, stem, end in marked:
            found[w] = found[stem] + (found[end] if end in found else self.table[end])
        if len(self.table) + len(found) > WORDS_KEPT:
            for k in list(islice(self.table, WORDS_KEPT // 2, None)):
                del self.table[k]
        self.table.update(found)
        return found

    def split(self, text: str) -> list[str] | None:
        """The words of a text, or None where it must be encoded whole."""
        low = text.lower()
        # in lower case too: words go to the library in lower case, and must not become added tokens there
        if _OTHER_SPACE.search(text) or any(a in text or a in low for a in self.added):
            return None
        if text.isascii() or _SIMPLE.fullmatch(text):
            return low.split()  # the tokenizer's own step; done here, a word recurs more often
        return text.split() if unicodedata.is_normalized("NFC", text) else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        get = self.table.get
        split = list(map(self.split, texts))
        got = [None if s is None else list(map(get, s)) for s in split]
        new = self.learn({w for s, g in zip(split, got, strict=True) if g and None in g for w, x in zip(s, g, strict=True) if x is None})
        whole = iter(self.whole([t for t, s in zip(texts, split, strict=True) if s is None]))
        out = []
        for s, g in zip(split, got, strict=True):
            if g is None:
                out.append(next(whole))
            elif None in g:
                out.append(b"".join([new[w] if x is None else x for w, x in zip(s, g, strict=True)]))
            else:
                out.append(b"".join(g))
        return out


@lru_cache(maxsize=2)
def _words(path: str, wide: bool) -> Words:
    """One for each tokenizer in a worker process, kept from task to task."""
    return Words(path, wide)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, wide: bool = False) -> None:
    """Encodes every whole text (null: empty), appends end_id to each, and writes the token file in ascending doc_id order.

    wide: ids of 65,536 and more can occur. Equal ids are ordered by text; null ids come first. Documents go to runs of
    doc_id of about equal bytes; the ids are kept once as plain blocks, since the code needs the counts of all of them.
    """
    parts, kind = shuffle_partitions(docs.sparkSession), "<u4" if wide else "<u2"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.withColumn("part", id_part(id_cuts(rows, RUNS * parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "doc_id", "text")
    end = np.array([end_id], kind).tobytes()

    def tokenise(batches):
        import pyarrow as pa

        known = _words(tokenizer, wide)
        gc.disable()  # millions of words in lists, none of them in cycles
        width = np.dtype(kind).itemsize
        part, block, first, held, n = None, 0, 0, [], 0

        def close():
            nonlocal block, first, held, n
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([[d for d, _ in held]], pa.list_(pa.int64())), pa.array([[len(x) // width for _, x in held]], pa.list_(pa.int32())), pa.array([b"".join(x for _, x in held)], pa.binary())],
                names=["part", "block", "first", "doc_ids", "counts", "ids"],
            )
            block, first, held, n = block + 1, first + n, [], 0
            return row

        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids, texts, of = (b.slice(at, 512).column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "part"))
                for p, d, x in zip(of, ids, known.encode(texts), strict=True):
                    if p != part:
                        if held:
                            yield close()
                        part, block, first = p, 0, 0
                    held.append((d, x + end))
                    n += len(x) // width + 1
                    if n >= BLOCK:
                        yield close()
        if held:
            yield close()
        gc.enable()

    plain = written(ordered.mapInArrow(tokenise, "part int, block int, first long, doc_ids array<long>, counts array<int>, ids binary"), "plain-ids")

    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                c = np.bincount(np.frombuffer(x.as_py(), kind))
                if len(c) > len(total):
                    c[: len(total)] += total
                    total = c
                else:
                    total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    counts = plain.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row an id of the vocabulary
    size = max((r["id"] for r in counts), default=0) + 1
    total = np.zeros(size, np.int64)
    for r in counts:
        total[r["id"]] = r["n"]
    lengths = code_lengths(total)
    codes = canonical(lengths)
    spark = docs.sparkSession
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    sums = sorted((r["part"], r["n"]) for r in plain.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, at = [], 0
    for p, n in sums:
        starts.append((p, at))
        at += n
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{path}/parts")
    table = spark.sparkContext.broadcast((lengths, codes))

    def encode(batches):
        import pyarrow as pa

        lengths, codes = table.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                c = b.slice(at, 64).columns
                got = [pack(np.frombuffer(x.as_py(), kind), lengths, codes) for x in c[5]]
                yield pa.RecordBatch.from_arrays([*c[:5], pa.array([c for _, c in got], pa.list_(pa.int64())), pa.array([p for p, _ in got], pa.binary())], names=["part", "block", "first", "doc_ids", "counts", "checkpoints", "payload"])

    plain.mapInArrow(encode, "part int, block int, first long, doc_ids array<long>, counts array<int>, checkpoints array<long>, payload binary").write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32) and, if asked for, ids; read from a token file."""
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, np.int64)
    for r in code:
        lengths[r["id"]] = r["bits"]
    starts = {r["part"]: r["start"] for r in spark.read.parquet(f"{path}/parts").collect()}
    shared = spark.sparkContext.broadcast((lengths, starts))

    def decode(batches):
        import pyarrow as pa

        lengths, starts = shared.value
        decoder = Decoder(lengths)
        for b in batches:
            held, n = [], 0
            for i in range(b.num_rows):
                held.append({c: b.column(k)[i].as_py() for k, c in enumerate(("part", "first", "doc_ids", "counts", "checkpoints", "payload"))})
                n += sum(held[-1]["counts"])
                if n < DECODED and i < b.num_rows - 1:
                    continue
                got = decoder.unpack([(r["payload"], np.array(r["checkpoints"], np.int64), sum(r["counts"])) for r in held])
                rows = []
                for r, x in zip(held, got, strict=True):
                    x, at, start = x.astype("<u4"), 0, starts[r["part"]] + r["first"]
                    for d, c in zip(r["doc_ids"], r["counts"], strict=True):
                        own = x[at : at + c]
                        rows.append((d, start + at, c, zlib.crc32(own.tobytes()), *([own.tolist()] if ids else [])))
                        at += c
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *([pa.array(cols[4], pa.list_(pa.int64()))] if ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])
                held, n = [], 0

    blocks = spark.read.parquet(f"{path}/blocks").select("part", "first", "doc_ids", "counts", "checkpoints", "payload")
    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def token_round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the documents' token file into the shared folder and returns what is read back from it (see read_tokens).

    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"tokens-{uuid.uuid4().hex}")
    write_tokens(docs, path, tokenizer or tokenizer_path())
    return read_tokens(spark, path)
