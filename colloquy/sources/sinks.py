"""File sinks: tables, records, resumable appends, guarded rewrites, and lines for print.  Each returns its path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_table(rows: DataFrame, path: str, compression: str = "none") -> str:
    rows.write.csv(path, header=True, escape='"', compression=compression)
    return path


def jsonl_append(rows: DataFrame, path: str) -> str:
    """One record a row, added to what is there."""
    rows.write.mode("append").json(path)
    return path


def json_arrays(rows: DataFrame, path: str) -> str:
    """JSON documents, each the array of one partition's records, in a file of its own, as readers take one document a file."""
    records = rows.select(F.to_json(F.struct(*rows.columns)).alias("r"), F.spark_partition_id().alias("p"))
    records.groupBy("p").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("r")), F.lit("]")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def text_files(rows: DataFrame, path: str, key: str) -> str:
    """One file a row: the texts ``value``, in folders by ``key``."""
    rows.select(key, "value").write.partitionBy(key).text(path)
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resumable_append(rows: DataFrame, path: str, keys: list[str]) -> str:
    """Append the rows whose key is not there yet.  A run that was cut short is taken up by the next."""
    spark = rows.sparkSession
    if _exists(spark, path):
        done = spark.read.schema(rows.schema).json(path).select(*keys)
        rows = rows.join(done, keys, "left_anti")
    return jsonl_append(rows, path)


def current(spark: SparkSession, path: str) -> str:
    """The newest version of a guarded table."""
    versions = spark.read.text(f"{path}/versions").agg(F.max("value")).first()[0]
    return f"{path}/{versions.split(' ')[1]}"


def guarded_rewrite(rows: DataFrame, path: str, primary: bool) -> str:
    """Write a new version of a table; the versions before it stay as its backups.  Only primary inputs may."""
    if not primary:
        raise ValueError("only the primary input may rewrite this table; give another path")
    spark = rows.sparkSession
    n = spark.read.text(f"{path}/versions").count() if _exists(spark, f"{path}/versions") else 0
    name = f"v{n}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{path}/{name}")
    spark.range(1).select(F.lit(f"{n:09d} {name}")).write.mode("append").text(f"{path}/versions")  # the version counts once it is named here
    return path


def latex_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A table row a line, with the signs escaped that LaTeX reads as its own."""
    cell = lambda c: F.regexp_replace(F.col(c).cast("string"), "([&%$#_{}])", "\\\\$1")
    return rows.select(F.concat(F.concat_ws(" & ", *[cell(c) for c in columns]), F.lit(" \\\\")).alias("line"))


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")).alias("line"))


def manifest(rows: DataFrame) -> DataFrame:
    """``rows, columns, digest`` of a table, whatever the order of its rows."""
    own = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns])), 1, 8), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("rows"), F.lower(F.hex(F.coalesce(F.sum(own), F.lit(0)))).alias("digest")).withColumn("columns", F.lit(",".join(rows.columns)))
