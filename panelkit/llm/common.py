"""Helpers that several operators share."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch whose texts are worked on together.
SLICE = 512
#: Runs of ids for each task, so that tasks are even though runs are dealt to them by hash; narrow runs that are
#: counted for each run; bytes that a row has besides its text.
RUNS, FINE, ROW_BYTES = 8, 2, 64


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names.

    Where it is unset, a local session (all of it on one machine) gets a new folder; on a cluster that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="panelkit-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later steps read written files, so a lost executor costs no recomputation of the past."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again (columnar, so later reads prune columns)."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what written() has written, once no plan that is still to run reads it."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int):
    """crc32(column as text) mod n, the rule of the held-out folds."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def id_cuts(docs: DataFrame, parts: int, key: str = "doc_id", text: str = "text") -> list[int]:
    """Ascending values of key that split the rows into at most about ``parts`` runs of about equal size in bytes.

    Every cut is a key that occurs. Rows are first counted into FINE narrow runs a part, then neighbours are put
    together up to the size of a part, so a run is larger only by what one narrow run or one key holds. At most
    FINE * parts numbers reach the driver, whatever the number of rows.
    """
    at = [i / (FINE * parts) for i in range(1, FINE * parts)]
    got = docs.agg(F.percentile_approx(key, at, max(10_000, 10 * len(at))).alias("c")).first()["c"] if parts > 1 else None
    cuts = sorted(set(got or []))
    if not cuts:
        return []
    size = F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES))
    sizes = {r["run"]: r["n"] for r in docs.groupBy(id_part(cuts, key).alias("run")).agg(size.alias("n")).collect()}
    target, held, out = sum(sizes.values()) / parts, 0, []
    for run, cut_at in enumerate(cuts):
        held += sizes.get(run, 0)
        if held and held + sizes.get(run + 1, 0) / 2 >= target:
            out.append(cut_at)
            held = 0
    return out


def id_part(cuts: list[int], key: str = "doc_id"):
    """The number of cuts at or below key: the run that a row belongs to. Null keys come first.

    Looked up in two levels, so a row is compared with about twice the root of the number of cuts.
    """
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  one folded constant
    below = lambda arr: F.size(F.filter(arr, lambda c: c <= F.col(key)))
    blocks = below(numbers(cuts[step - 1 :: step])) if len(cuts) >= step else F.lit(0)
    return F.when(F.col(key).isNull(), 0).otherwise(blocks * step + below(F.slice(numbers(cuts), blocks * step + 1, F.lit(step))))


def lower_words(text: str) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased: runs without space and U+0009 to U+000D (as bytes.split() has it)."""
    return text.encode("utf-8", "surrogatepass").lower().split()
