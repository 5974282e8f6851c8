"""The training-data pipeline: five stages, each of which writes what the next one reads.

1. quality classifier: documents that the byte network rejects go;
2. SimHash near-duplicates: of each component (fingerprints of three-word shingles at most two bits apart, in steps) the row
   with the smallest id (nulls last) stays;
3. substring dedup: repeated passages go from the texts; a text that changes is its words left, joined by one space;
4. mixing: a row for each pass of the mix through a document, with the words that it takes;
5. BPE: the number and digest of the ids of every row, and the digest of what they decode to.

All but the last return the columns of ``documents``. Rows whose text is null or empty pass through: the first stage
judges them by score like any other, later ones find nothing in them, and the mix takes no word of them, so they end there.
The second stage judges rows, whatever ids they share or lack: exactly one of each component stays; of rows that tie, the first
in the order of reading. Equal texts always share a component. Very long texts are read whole by every stage, in
blocks where a stage needs more than the words. Without documents every stage returns an empty table; without labels the
first one keeps everything. Columns that ``documents`` does not have are carried along under their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelark.llm import bpe, mixing, quality_model, simhash, substrings
from wirelark.llm.common import own_names, read_table
from wirelark.llm.vocabulary import WORD_TOKENIZER
from wirelark.session import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that the classifier, fitted on the labels of ``sf_dir``, scores below its threshold."""
    plain = own_names(docs, COLUMNS)
    scored = quality_model.scored(plain, quality_model.fitted(plain, read_table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= quality_model.ACCEPT).drop("score").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest id (nulls last), of those the first row."""
    plain = own_names(docs, COLUMNS)
    rows = store(plain.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    return rows.join(simhash.first_rows(rows), "row", "left_semi").select(*plain.columns).toDF(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the words of repeated passages."""
    plain = own_names(docs, COLUMNS)
    changed = F.col("kept").isNotNull()
    length = F.length("kept").cast(docs.schema["n_chars"].dataType)
    found = substrings.removed_passages(plain).withColumns(
        {"text": F.coalesce("kept", "text"), "n_chars": F.when(changed, length).otherwise(F.col("n_chars"))}
    )
    return found.select(*plain.columns).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of ``docs`` to the target weights holds."""
    return mixing.mixed_documents(own_names(docs, COLUMNS)).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row."""
    return bpe.round_trip(docs, WORD_TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier cannot be expressed in SQL.
ORACLE_SQL: str | None = None
