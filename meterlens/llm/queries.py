"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlens.llm import (
    bestfit,
    conversation_repair,
    decontam,
    html_text,
    langid,
    lexical,
    licenses,
    minhash,
    packing,
    pii,
    secret_scan,
    tokenfile,
    topk,
)
from meterlens.llm.common import table

#: Folder of the tokenizer files; without it the installed public_tokenizers package names the files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(table(spark, sf_dir, "documents"))


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digest(table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digest(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": near_dedup,
    "op2_language_id": language,
    "op3_exact_topk": exact_topk,
    "op4_token_files": token_files,
    "op5_html_text": page_text,
    "op6_packing": pack_sequences,
    "op7_decontamination": contamination,
    "op8_personal_data": personal_data,
    "op9_license_scan": license_scan,
    "op10_secret_scan": secrets,
    "op11_lexical_search": lexical_search,
    "op12_best_fit_packing": best_fit,
    "op13_conversation_repair": conversations,
}
