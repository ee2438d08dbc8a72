"""The corpus pipeline: five stages from `documents` to token ids, each reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortie.llm import bpe, common, decontam, langid, nearcopies, pii, queries
from sortie.session import fresh_folder, pin

#: A document whose likeliest language has less of the probability than this is rejected, as is one without a letter.
LEAST_SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language; their `lang` (null included) is filled in where it was null."""
    common.bounded(spark)
    learned = langid.fit(docs.where(common.id_remainder(F.col("doc_id"), 4) != 2))
    named = docs.select("*", langid.predicted(learned, F.col("text")).alias("_stage_predicted"))
    sure = named.where((F.col("_stage_predicted.lang") != langid.UNKNOWN) & (F.col("_stage_predicted.score") >= LEAST_SURE))
    return sure.withColumn("lang", F.coalesce("lang", "_stage_predicted.lang")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity 0.8 of five-word shingles) keeps the document with the smallest id."""
    common.bounded(spark)
    return nearcopies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, exactly or nearly."""
    common.bounded(spark)
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the kind's name; n_chars follows the new text."""
    common.bounded(spark)
    safe = docs.withColumn("_stage_safe", pii.replaced(pii.fit(docs), F.col("text"))).withColumn("text", F.col("_stage_safe.text"))
    return safe.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether decoding them gives the text's bytes again."""
    common.bounded(spark)
    path, pattern = queries.public_vocabulary()
    both = docs.select("doc_id", "lang", "source", "text", bpe.round_trip(F.col("text"), path, pattern).alias("b"))
    same = F.col("b.decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", F.col("b.ids").alias("ids"), F.size("b.ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL expresses no stage but parts of the fourth; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's rows are written to the shared folder and read again."""
    docs = common.table(pin(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
