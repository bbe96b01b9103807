"""The corpus pipeline: language ID, toxicity, near-duplicate join, mixing and packing over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import jaccard, langid, mixing, packing, queries, toxicity
from colloquy.llm.common import table, written

#: A document whose words are less likely than its language's learned texts by so many deviations is of no learned language.
SURPRISE = 5.0


def _beside(docs: DataFrame, *found: Column) -> DataFrame:
    """The rows as one column ``row``, beside what a stage finds, so that no name can clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), *found)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose words are too unlikely in every learned language.

    Null, empty and blank texts go; ties, repeated rows and null ids are judged by their text alone; an empty table stays so.
    """
    model = queries.language_model(spark, sf_dir)
    found = _beside(docs, langid.judge("text", model).alias("l"))
    return found.where(f"l.lang <> '{langid.UNDETERMINED}' and l.surprise < {SURPRISE}").select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are likelier toxic than not; null and empty texts are clean, repeated rows are judged alike."""
    model = queries.toxicity_model(spark, sf_dir)
    return _beside(docs, toxicity.toxicity("text", model).alias("t")).where("t.score < 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of linked rows: that of the smallest document, by hash of the row among equal ids.

    The join sees rows by a key of their own, so repeated and null ids are rows like others.  Texts without a word
    link with nothing and all stay.
    """
    rows = written(_beside(docs, F.monotonically_increasing_id().alias("at")))
    found = jaccard.join(rows, key="at", text="row.text").select(F.col("doc_id").alias("at"), "component_id")
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", F.xxhash64("row"), "at")
    ranked = rows.select("at", order.alias("o")).join(found, "at")
    kept = ranked.groupBy("component_id").agg(F.min("o").getField("at").alias("at"))
    return rows.join(kept, "at", "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin out documents to the target weights of the domains; texts without a word stay once."""
    train = queries.sampled(spark, sf_dir, mixing.FIT_DOCS, "mixing-fit")
    return mixing.apply(docs, train, queries.TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a document without text is one separator."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained models, an iterative join and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
