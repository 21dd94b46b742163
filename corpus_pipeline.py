"""From raw documents to token ids, stage by stage; each stage reads what the one before it wrote.

Every stage but the last returns the columns it was given. Stages handle null and repeated rows, empty tables and further
columns as the operators they call do: a null text has no words, so it is rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcadence.llm import mixing, pii, quality, simhash
from hexcadence.llm.base import free_names, named, stored
from hexcadence.llm.workload import tokens_and_text, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near enough to their language."""
    (verdict,) = free_names(docs, "quality")
    judged = quality.assess(docs, "text", "lang", into=verdict)
    return judged.where(F.col(verdict)["kept"]).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id (nulls last; of repeated rows, one)."""
    uid, key = free_names(docs, "uid", "key")
    rows = stored(docs.withColumn(uid, F.monotonically_increasing_id()), "documents")
    whole = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(uid))
    classes = simhash.near_components(rows.select("text", whole.alias(key)), key, "text")
    dropped = stored(classes.where(F.col(key) != F.col("component_id")).select(F.col(key)[uid].alias(uid)), "dropped")
    return rows.join(dropped, uid, "left_anti").select(*[named(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind; n_chars follows the text."""
    masked = pii.mask(docs, "text")
    if "n_chars" not in masked.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    uid, times = free_names(docs, "uid", "times")
    rows = stored(docs.withColumn(uid, F.monotonically_increasing_id()), "documents")
    sizes = rows.select(F.col(uid).alias("uid"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(sizes, "source", "size", ["doc_id", "uid"]).where("copies > 0")
    taken = rows.join(mixed.select(F.col("uid").alias(uid), F.col("copies").alias(times)), uid)
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))
    return taken.withColumn(uid, again).select(*[named(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, token_ids (packed) and the digests of ids and decoded text."""
    return tokens_and_text(docs.select("doc_id", "source", "lang", "text"), vocabulary(), ids=True)


STAGES = [
    ("quality", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mix", source_mix),
    ("tokens", token_ids),
]

#: No stage but the word counts can be said in SQL: flights are drawn, fingerprints need XXH64, tokens need merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
