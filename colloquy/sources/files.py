"""File sources: CSV, JSON lines, JSON documents, folders that name a group, and texts with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, every column as text.  Compressed files are read by their suffix."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True)


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"', mode="FAILFAST")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def master_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, each an array of records.  A document is read by one task, as its lines are not records."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def by_folder(spark: SparkSession, base: str, schema: str, name: str, pattern: str = "*.json") -> DataFrame:
    """JSON lines below ``base``, with the folder of each file as column ``name``.

    Files and folders whose name begins with ``_`` or ``.`` are not read, and files right in ``base`` are left out.
    """
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(base)
    below = F.substring_index(F.col("_metadata.file_path"), f"{base.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return rows.select("*", below.alias("__below")).where("instr(__below, '/') > 0").withColumn(name, F.substring_index("__below", "/", 1)).drop("__below")


def front_matter(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Whole texts that begin with ``---`` and header lines: the given fields, and the ``body`` behind the header."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    head = [F.regexp_extract("value", f"(?m)^{f}: (.*)$", 1).alias(f) for f in fields]
    return rows.select(*head, F.regexp_replace("value", "(?s)^---\n.*?\n---\n|\n\\z", "").alias("body"))
