"""The corpus pipeline: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder and
reads it again for the next one, so a lost executor never costs more than a stage.

In every stage: rows are kept or dropped whole, in no particular order; all columns of docs are returned (the last stage
returns bins), whatever else they are called; an empty table gives an empty table. Texts of any length are read whole.
"""

from __future__ import annotations

from panelkit.llm.common import written
from panelkit.llm.decontam import drop_contaminated
from panelkit.llm.langid import drop_unidentified
from panelkit.llm.lines import dedup_units
from panelkit.llm.packing import pack_documents
from panelkit.llm.simhash import drop_near_copies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null and empty texts, texts without a letter, and texts in none of the learned languages go. Repeated rows share
    their fate, as each row is judged by its text alone; a null doc_id or lang makes no difference.
    """
    return drop_unidentified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five-word shingles, resemblance of 0.8 or more) the first document.

    The first has the smallest doc_id; of rows that repeat it all stay, rows with a null doc_id stay. Null and empty
    texts have no shingle and are copies of each other. Ties in doc_id are one document.
    """
    return drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier in the corpus; n_chars follows the text.

    No row goes, not even one that is left with an empty text. Null texts stay null. Earlier: smaller doc_id, then
    place; null ids rank last; rows that agree in doc_id and text are one document and stay equal.
    """
    got = dedup_units(docs, "passage").select(docs.columns)
    return got.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else got


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A row goes with all rows of its doc_id; null and empty texts hold nothing, rows with a null doc_id stay. Without a
    benchmark item all stay.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of all documents that are left, one row per piece; null and empty texts are pieces of size 0."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("repeats", repeats), ("leaks", leaks), ("packing", packing)]

#: No DuckDB counterpart: cross-parsing, fingerprints and packing can't be put in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
