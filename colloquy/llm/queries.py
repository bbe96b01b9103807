"""The ``opN_<name>`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import chat, fingerprint, html_extract, jaccard, langid, licenses, mixing, oracles, packing, quality, toxicity
from colloquy.llm.common import fold, table

#: Domains of the labelled table and the shares of all tokens that the mixture gives them.
TARGETS = {"good": 0.95, "poor": 0.04, "toxic": 0.01}
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 0 then 'poor' when quality = 1 then 'good' end"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, as ``doc_id, text, quality, toxic, domain``."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id").withColumn("domain", F.expr(DOMAIN))


def sampled(spark: SparkSession, sf_dir: str, n: int, seed: str, where: str | None = None) -> DataFrame:
    """About ``n`` labelled documents for fitting, picked before the texts are read: ids first, then a broadcast of at most about ``n`` rows."""
    from colloquy.llm.common import at_most

    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    picked = at_most(labels.where(where) if where else labels, n, seed, "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(picked), "doc_id").withColumn("domain", F.expr(DOMAIN))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    train = sampled(spark, sf_dir, toxicity.FIT_DOCS, "toxicity-fit", "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")
    return toxicity.fit(train)


def language_model(spark: SparkSession, sf_dir: str) -> langid.LanguageModel:
    return langid.fit(table(spark, sf_dir, "documents").where(fold("doc_id", 3) != 1))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity.toxicity("text", model).alias("t"))
    return rows.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.col("t.hits").alias("hits"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_model(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), langid.predict("text", model).alias("l"))
    return rows.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), F.col("l.n_languages").alias("n_languages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.windows(rows.unionByName(extra)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), sampled(spark, sf_dir, mixing.FIT_DOCS, "mixing-fit"), TARGETS)
    return mixed


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_html_extraction, op3_language_id, op4_best_fit_packing, op5_license_scan, op6_quality_rules, op7_fingerprint, op8_chat_format, op9_mixing, op10_ngram_jaccard)}
#: The others need trained models, a tokenizer, the fingerprint's or the window's own form; tests hold them against brute force.
ORACLE_SQL = oracles.ORACLE_SQL
