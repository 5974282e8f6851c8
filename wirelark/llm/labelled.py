"""Labelled rows for the classifiers: which are held out, and bounded samples of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.llm.common import broadcast_if_small
from wirelark.session import store

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text is divisible by ``FOLDS``. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int]) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of about ``bounds[value]`` documents of each label value, or all if there are fewer.

    Documents are chosen by a hash of their id, so reruns agree, and only from those that are not held out. An id has one row, however many
    documents or labels share it: the text with the least hash, and the least label.
    """
    open_ = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in open_.groupBy(label).count().collect()}
    place = F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(1 << 30))
    share = F.lit(0)
    for value, bound in bounds.items():
        share = F.when(F.col(label) == value, F.lit(int((1 << 30) * min(1.0, bound / max(1, counts.get(value, 0)))))).otherwise(share)
    least = open_.where(place < share).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    chosen = store(least, "sample")
    found = docs.select("doc_id", "text").join(broadcast_if_small(chosen), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return one.select("doc_id", "first.text", "label")
