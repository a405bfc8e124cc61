"""Scans and sinks. Schemas are always declared; nothing is inferred."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import assert_unique


@dataclass(frozen=True)
class Parameters:
    """Windows and levels of an analysis: event window and its reference, level of the gate, draws, least cohort, periods of a cohort before and after its treatment, lead of a false treatment, seed."""

    window: tuple[int, int] = (-5, 5)
    reference: int = -1
    alpha: float = 0.05
    draws: int = 500
    composition_draws: int = 30
    min_cohort: int = 200
    before: int = 2
    after: int = 3
    lead: int = 3
    seed: int = 42


def read_delimited(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """A quoted, delimited file with a header; only the wanted columns are read."""
    df = spark.read.schema(schema).option("sep", sep).option("quote", '"').option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    return read_delimited(spark, path, schema, columns, ",")


def read_price_index(spark: SparkSession, path: str) -> DataFrame:
    """month_end, cpi of a landed monthly series with the columns observation_date and value."""
    return read_csv(spark, path, "observation_date date, value double").select(F.last_day("observation_date").alias("month_end"), F.col("value").alias("cpi"))


def read_panels(spark: SparkSession, base: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}


def read_law_panel(spark: SparkSession, path: str, score: str = "std_score", columns: list[str] | None = None) -> DataFrame:
    """state_fips (two digits), filing_year, score and further columns of a landed law panel; (state, year) must be unique.

    A state code that is no number makes the row's key NULL: such rows join nothing and may repeat.
    """
    d = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    d = d.select(F.lpad(F.floor(F.expr("try_cast(state_fips as double)")).cast("int").cast("string"), 2, "0").alias("state_fips"), F.expr("try_cast(year as int)").alias("filing_year"), F.expr(f"try_cast(`{score}` as double)").alias(score), *(columns or []))
    known = F.col("state_fips").isNotNull() & F.col("filing_year").isNotNull()
    return assert_unique(d.where(known), "state_fips", "filing_year").unionByName(d.where(~known))


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, inputs: list[str]) -> str:
    """A hash of names, sizes and times of all files below the inputs: what a changed input changes."""
    h = hashlib.sha256()
    for path in sorted(inputs):
        at, fs = _hadoop(spark, path)
        found = []
        if fs.exists(at):
            files = fs.listFiles(at, True)
            while files.hasNext():
                f = files.next()
                found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
        h.update("\n".join([path, *sorted(found), ""]).encode())
    return h.hexdigest()


def _marker(spark: SparkSession, path: str) -> dict | None:
    at, fs = _hadoop(spark, f"{path}/current.json")
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/current.json").collect())) if fs.exists(at) else None


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False, inputs: list[str] | None = None) -> DataFrame:
    """The table kept under path; built and written first where it is missing, an input has changed or a rebuild is asked for.

    Each build goes to a folder of its own. A marker, put in place by a rename once the write is complete, names the
    current one with the inputs' fingerprint; so a build that died half-way is never read, and readers of the build
    before are not disturbed until it is removed, after the new marker stands.
    """
    now = fingerprint(spark, inputs or [])
    marker = _marker(spark, path)
    if marker and not rebuild and marker["inputs"] == now:
        return spark.read.schema(marker["schema"]).parquet(f"{path}/{marker['folder']}")
    table, folder = build(), f"build-{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{folder}")
    said = json.dumps({"folder": folder, "inputs": now, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)})
    draft, fs = _hadoop(spark, f"{path}/draft-{folder}")
    out = fs.create(draft, True)
    out.write(bytearray(said.encode()))
    out.close()
    at, _ = _hadoop(spark, f"{path}/current.json")
    fs.delete(at, False)
    if not fs.rename(draft, at):
        raise OSError(f"another build of {path} was put in place meanwhile")
    for status in fs.listStatus(_hadoop(spark, path)[0]):
        name = status.getPath().getName()
        if name.startswith(("build-", "draft-")) and name != folder:
            fs.delete(status.getPath(), True)
    return spark.read.schema(table.schema).parquet(f"{path}/{folder}")


def drop_cached(spark: SparkSession, path: str) -> None:
    """Removes a kept table with its marker."""
    at, fs = _hadoop(spark, path)
    fs.delete(at, True)


def write_panel(df: DataFrame, path: str, partition: str | None = "data_year") -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition and partition in df.columns else w).parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
