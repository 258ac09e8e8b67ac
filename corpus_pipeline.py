"""Documents to packed training sequences, in stages that each call one operator of ``spectraloom.llm``.

All stages but the last return the columns of the documents they get, whatever these are; ``doc_id, text`` and, for
learning, ``lang`` must be among them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import langid, packing, secrets, simhash, toxicity
from spectraloom.llm.common import fresh, small_batches
from spectraloom.llm.queries import tokenizer_path
from spectraloom.plans.lineage import shared_folder

#: Documents whose language is less certain are rejected; unmixed prose scores above 0.9.
LEAST_CERTAIN = 0.4
TOXIC = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told. Texts without letters go; where no document says its language, only they."""
    small_batches(spark)
    model = langid.learn_languages(langid.taught(docs))
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = fresh(docs, "found")
    told = docs.withColumn(found, langid.predicted(F.col("text"), model, docs))
    sure = (F.col(found)["lang_pred"] != langid.UNKNOWN) & (F.col(found)["score"] >= LEAST_CERTAIN)
    return told.where(sure).drop(found)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not call toxic; a NULL text is judged as an empty one."""
    small_batches(spark)
    score = fresh(docs, "score")
    found = toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), docs.columns, score)
    return found.where(F.col(score) < TOXIC).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs, length_column="n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("toxicity", not_toxic),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("packing", packed),
]

# Learned models, fingerprints and tokenizers are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read again by the next."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
