"""A training-data pipeline over `documents`: language, near-duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlens.llm import decontam, langid, minhash, packing, secret_scan
from meterlens.llm.common import cut, table
from meterlens.llm.queries import tokenizer_path
from meterlens.session import ensure_checkpoint_dir

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence. Texts without a letter go."""
    found = langid.identify(docs, langid.train(docs))
    return found.filter(~F.col("lang_rejected")).select(*DOCUMENTS)


def ids_are_keys(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return rows == ids


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8 or more): that of the smallest id.

    Rows that repeat a doc_id with other texts, and rows without one, are documents of their own; the latter come last. Of
    texts without a word only rows of one doc_id and text are copies.
    """
    if ids_are_keys(docs):
        kept = minhash.near_duplicates(docs).filter("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*DOCUMENTS)
    # Keys in the order of the ids. They are written, so that every step reads the same ones.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.xxhash64(*DOCUMENTS)]
    keyed = cut(docs.select(*DOCUMENTS).orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    kept = minhash.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).filter("kept")
    stay = keyed.join(kept.select(F.col("doc_id").alias("_row")), "_row", "left_semi")
    same = stay.filter("doc_id is not null").groupBy("doc_id", F.sha2("text", 256)).agg(F.min("_row").alias("_row")).select("_row")
    same = same.union(stay.filter("doc_id is null").select("_row"))
    return stay.join(same, "_row", "left_semi").select(*DOCUMENTS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item, each row by its own text."""
    benchmark = table(spark, sf_dir, "benchmark")
    if ids_are_keys(docs):
        return decontam.decontaminated(docs, benchmark).select(*DOCUMENTS)
    keyed = cut(docs.select(*DOCUMENTS).withColumn("_row", F.monotonically_increasing_id()))
    found = decontam.overlaps(keyed.select(F.col("_row").alias("doc_id"), "text"), benchmark)
    return keyed.join(found.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*DOCUMENTS)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; n_chars follows the text."""
    return secret_scan.redacted(docs).select(*DOCUMENTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 2048 ids."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_removal),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet in the shared folder and read again by the next one."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
