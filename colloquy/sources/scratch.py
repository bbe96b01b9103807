"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; a session without one (a local test) gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/colloquy-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written and read again: evaluated once, with a short lineage."""
    path = folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
