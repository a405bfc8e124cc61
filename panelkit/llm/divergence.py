"""Source divergence audit: how the term frequencies of each source of a language differ from those of the others.

A translate table lower-cases A-Z and blanks every separator byte in one pass over a text; bytes.split cuts it and a
Counter per document gives frequencies. Tasks fold these into sparse (lang, source, term) rows before anything is
shuffled; Spark adds them up, keeps the terms in enough documents of their language, and ranks.

A term is a run of A-Z, a-z and non-ASCII characters. With V kept terms of a language, N occurrences of them in a group
and n of one term, p = 1 + floor(10^9 (n + 5) / (N + 5 V)); all arithmetic is on integers.

Cases: null texts, languages and sources count as ''. A group (lang, source) without any term is there all the same.
Each row is a document, repeated rows too; ids play no part and may be null. Ties rank by the item's UTF-8 bytes. A
language with one source has no pairs; one without kept terms has pairs of value 0 and no terms. Texts of any length are
counted piece by piece. An empty table gives an empty result. Other columns of docs are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents of a language that a kept term occurs in at least; top ranks of terms; what is added to each count.
MIN_DOCS, TOP, PRIOR = 30, 50, 5
#: Entries that a task holds before it gives them away; bytes of a text that are split at once; terms of a block of pairs.
HELD, PIECE, BLOCK = 400_000, 1 << 20, 1024

#: Separators (all ASCII but letters) become blanks, A-Z become a-z, bytes of non-ASCII characters stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def document_terms(text: bytes) -> Counter:
    """Frequencies of the terms of one text, split in pieces that end at separators."""
    clean, got, at = text.translate(TABLE), Counter(), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        got.update((clean[at:end] if at or end < len(clean) else clean).split())
        at = end
    return got


def _folded(batches: Iterator) -> Iterator:
    """Sums by (lang, source, term) of frequencies and documents, given away whenever HELD entries are reached."""
    import pyarrow as pa

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def out() -> Iterator:
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                some = terms[i : i + 50_000]
                columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([df[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            terms = document_terms(text.as_buffer().to_pybytes())
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            entries -= len(n)
            df.update(terms.keys())
            n.update(terms)
            entries += len(n)
            if entries >= HELD:
                yield from out()
                held, entries = {}, 0
    yield from out()


def term_cells(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term (binary), n, n_lang (occurrences in the language), first (once per lang and term): kept terms.

    One shuffle, by (lang, term): the sums by source and those over sources both fit it.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parts = rows.mapInArrow(_folded, "lang string, source string, term binary, n long, df long").repartition("lang", "term")
    cells = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    own = Window.partitionBy("lang", "term")
    seen = cells.withColumns({"n_lang": F.sum("n").over(own), "df": F.sum("df").over(own), "first": F.row_number().over(own.orderBy("source")) == 1})
    return seen.where(F.col("df") >= min_docs).drop("df")


def _share(n: str, total: str, terms: str) -> str:
    """p as SQL, by the names of its columns; exact for counts up to 10^19."""
    return f"1 + (cast({n} + {PRIOR} as decimal(20, 0)) * cast(1000000000 as decimal(10, 0))) div cast({total} + {PRIOR} * {terms} as decimal(20, 0))"


def _distances(rows):
    """Of one (lang, block): a, b (a before b) and the sum over the block's terms of the differences of their p.

    rows: source and p of each term's cells, and for each source a row without term: its p of terms it does not have.
    A source's whole row of the block is made once; a third of all documents in one source are one row here too.
    """
    import numpy as np
    import pyarrow as pa

    lang, source, term, p = rows["lang"][0].as_py(), rows["source"].to_pylist(), rows["term"].to_pylist(), rows["p"].to_numpy()
    own = sorted((s, i) for i, (s, t) in enumerate(zip(source, term, strict=True)) if t is None)
    at, column = {s: i for i, (s, _) in enumerate(own)}, {}
    cells = np.array([(i, at[s], column.setdefault(t, len(column))) for i, (s, t) in enumerate(zip(source, term, strict=True)) if t is not None], np.int64).reshape(-1, 3)
    shares = np.repeat(p[[i for _, i in own]][:, None], len(column), axis=1)
    shares[cells[:, 1], cells[:, 2]] = p[cells[:, 0]]
    apart = [np.abs(shares[i + 1 :] - shares[i]).sum(axis=1) for i in range(len(own))]
    first, other = np.triu_indices(len(own), 1)
    names = pa.array([s for s, _ in own], pa.string())
    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(first)), names.take(pa.array(first)), names.take(pa.array(other)), pa.array(np.concatenate(apart), pa.int64())]
    return pa.Table.from_arrays(columns, names=["lang", "a", "b", "value"])


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances to each other source of the language, and over-used terms.

    part pair: item is another source, value the sum over all kept terms of the differences of p; all ranks. part
    term: item is a term that the group has, with p above the language's q, value p - q; the first ranks.
    """
    cells = written(term_cells(docs, min_docs), "term-cells")
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = cells.groupBy("lang").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("terms"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own", "total", "terms"])
    groups = written(groups, "groups")  # one row a group

    x = cells.join(groups, ["lang", "source"]).withColumns({"p": F.expr(_share("n", "own", "terms")), "q": F.expr(_share("n_lang", "total", "terms"))})
    order = [F.desc("value"), F.asc("item")]
    term = x.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top).withColumn("item", F.col("item").cast("string"))

    most = groups.groupBy("lang").agg(F.max("terms").alias("v"), F.count("*").alias("s")).agg(F.max(F.ceil(F.col("v") / F.greatest(F.lit(BLOCK), F.col("s"))))).first()[0]  # one number
    blocks = max(1, int(most or 0))
    base = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "source", F.lit(None).cast("binary").alias("term"), F.when(F.col("terms") > 0, F.expr(_share("0", "own", "terms"))).otherwise(0).alias("p"))
    rows = x.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "source", "term", "p").unionByName(base)
    apart = rows.groupBy("lang", "block").applyInArrow(_distances, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = apart.select("lang", "value", sides.alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return pair.unionByName(term.select(pair.columns))
