"""The canonical span view, from tables or from nested conversation exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.ArrayType(T.StructType([T.StructField(c, t) for c, t in (("author", T.StringType()), ("message_number", T.IntegerType()), ("created_at", T.StringType()), ("content", T.StringType()))]))
EXPORT = T.StructType([T.StructField("id", T.StringType()), T.StructField("created_at", T.StringType()), T.StructField("persona_id", T.IntegerType()), T.StructField("learn_counselling_messages", MESSAGE)])
CONTAINERS = ("counsellings", "counselings", "conversations", "data")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``condition, conv, speaker, span, ts, label, value`` from the event table."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("user_id") % 3).alias("condition"),
        F.col("user_id").alias("conv"),
        F.when(F.col("event_id") % 2 == 0, "Client").otherwise("Counsellor").alias("speaker"),
        F.col("event_id").alias("span"),
        "ts",
        F.col("event_type").alias("label"),
        "value",
    )


def conversation_exports(spark: SparkSession, path: str) -> DataFrame:
    """Messages of nested exports: a list, a single object, or an object with one of four list keys.

    Unparsable files give no row.  ``conv_key`` holds the file, as ids repeat across exports.
    """
    wrapped = T.StructType([*EXPORT.fields, *[T.StructField(c, T.ArrayType(EXPORT)) for c in CONTAINERS]])
    raw = spark.read.schema(wrapped).json(path, multiLine=True, mode="DROPMALFORMED").withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    own = F.when(F.col("id").isNotNull() | F.col("learn_counselling_messages").isNotNull(), F.array(F.struct(*EXPORT.fieldNames())))
    rows = raw.select("source_file", F.explode(F.coalesce(*CONTAINERS, own)).alias("c"))
    rows = rows.select("source_file", F.col("c.id").alias("id"), F.concat_ws("::", "source_file", "c.id").alias("conv_key"), F.explode("c.learn_counselling_messages").alias("m"))
    return rows.select("source_file", "id", "conv_key", "m.*").withColumn("message_number", F.coalesce("message_number", F.lit(10**9)))
