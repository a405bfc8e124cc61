"""Stages: tables that are written once in the folder all executors share, and read from there by all later steps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session (all of it on one machine) gets a new one; on a cluster that is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="panelkit-stages-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the keys over as many partitions as spark.sql.shuffle.partitions names.

    Adaptive execution would join these into a few by their compressed size, and sorts and tables of a task take many
    times that memory.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """df as a written table: its past is not computed again, whoever reads it and whichever executor is lost."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
