"""The corpus pipeline: STAGES applied to documents, one after another.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
documents; the last returns packed pieces. Between stages, the documents are written as Parquet.

Nulls and odd cases are each operator's own; a document without identifier passes the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograin import session
from echograin.llm import common, exact_dedup, langid, packing, pii, simhash
from echograin.llm.tokens import public

#: A text whose best profile scores less is in none of the languages learnt; texts in one score 0.35 and more.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the corpus teaches, go."""
    session.ship(spark)
    profiles = langid.learn(docs.where(~langid.held_out()))
    # By place, so that no column's name clashes with the prediction's.
    placed = docs.withColumn("text", docs["text"].cast("string")).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = langid.predict(placed, profiles, f"c{docs.columns.index('text')}")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score").toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier stays."""
    session.ship(spark)
    return exact_dedup.drop_duplicates(docs, keep="smallest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one document stays.

    Near SimHash fingerprints are looked up by multi-index hashing; what they miss is found by the shingles.
    """
    session.ship(spark)
    return simhash.drop_near_duplicates(docs, words=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    session.ship(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: one row for each piece of a document."""
    session.ship(spark)
    return packing.pack(docs, public("word_bpe_49k.json"), capacity=2048)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("personal_data", personal_data), ("packing", pack)]

#: Language profiles, fingerprints and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
