"""The operators of this package as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelark.llm import bpe, chat, codebooks, html_text, id_files, mixing, quality_model, quality_rules, runs, simhash, substrings, topk, toxicity
from wirelark.llm.common import read_table
from wirelark.llm.vocabulary import BYTE_TOKENIZER, WORD_TOKENIZER

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat.with_probe(read_table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(conversations))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(read_table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read_table(spark, sf_dir, "documents")).select(*quality_rules.RESULT)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.coalesce(F.sha2("kept", 256), "words_sha256").alias("kept_sha256")
    return substrings.removed_passages(docs).select("doc_id", "n_words", "n_removed", digest)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.predictions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.id_file_digests(read_table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.code_digests(read_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(read_table(spark, sf_dir, "documents"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(read_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    made = [
        op1_mixing, op2_bpe, op3_chat_format, op4_top_k, op5_quality_rules, op6_simhash, op7_substring_dedup,
        op8_quality_model, op9_id_files, op10_toxicity, op11_vector_codes, op12_periodic_runs,
        op13_page_text,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.ORACLE,
        "op3_chat_format": chat.ORACLE,
        "op4_top_k": topk.ORACLE,
        "op5_quality_rules": quality_rules.ORACLE,
        "op7_substring_dedup": substrings.ORACLE,
        "op11_vector_codes": codebooks.ORACLE,
        "op13_page_text": html_text.ORACLE,
    }
