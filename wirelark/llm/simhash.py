"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a common neighbour that differs from each in at most one.
So every distinct fingerprint emits itself and its 64 one-bit variants; the shuffle on the variant brings
neighbours together. The members of a variant are itself or it with one bit flipped, hence a 64-bit mask and a flag
hold the whole group: a fixed-size buffer that is combined on the map side, however large the group.

Nulls and edge cases: a null, empty or blank text has no words and the fingerprint zero, which links like any
other; a text of fewer words than a shingle is one shingle; repeated rows share a fingerprint; a null ``doc_id``
is never the smallest unless its component has no other. An empty table gives an empty result.

``first_rows`` leaves one row of each component, whatever ids rows share or lack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wirelark.llm.common import byte_column, small_batches, word_blocks
from wirelark.session import store

HASH_SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by one space."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest, seed = xxhash.xxh64_intdigest, HASH_SEED
    found = [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return np.array(found, dtype=np.uint64)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The 64-bit SimHash of ``text`` as a signed integer."""
    votes, total, carry, seen = np.zeros(64, dtype=np.int64), 0, [], False
    for words in word_blocks((text or b"").translate(_LOWER)):
        words = carry + words
        if len(words) >= size:
            hashes = shingle_hashes(words, size)
            bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
            votes += bits.sum(axis=0, dtype=np.int64)
            total, seen = total + len(hashes), True
        carry = words[-(size - 1) :] if size > 1 else []
    if not seen and carry:
        hashes = shingle_hashes(carry, len(carry))
        votes, total = np.unpackbits(hashes.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``print``, the fingerprint of ``text``, for every row."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, size) for t in byte_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(prints, pa.int64())], names=[*keep, "print"])

    schema = StructType([*docs.select(*keep).schema.fields, StructField("print", LongType())])
    return docs.select(*keep, "text").mapInArrow(of, schema)


def ball_links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)``, a > b, that connect all distinct ``print`` values within two bits of each other.

    All members of a variant are within two bits of one another, so linking each to the smallest keeps every
    connection. At most 65 members share a variant.
    """
    flip = F.expr("shiftleft(1L, bit)")
    near = prints.select("print", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit")).select(
        F.when(F.col("bit") < 0, F.col("print")).otherwise(F.col("print").bitwiseXOR(flip)).alias("variant"),
        F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(flip).alias("mask"),
        (F.col("bit") < 0).cast("int").alias("own"),
    )
    met = (
        near.groupBy("variant")
        .agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
        .where(F.bit_count("mask") + F.col("own") > 1)
    )
    flipped = F.expr(
        "transform(filter(sequence(0, 63), i -> getbit(mask, i) = 1), i -> variant ^ shiftleft(1L, i))"
    )
    own = F.when(F.col("own") == 1, F.array("variant")).otherwise(F.array().cast("array<bigint>"))
    members = met.select(F.concat(flipped, own).alias("members"))
    pairs = members.select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    return pairs.where((F.col("a") != F.col("b")) & close).distinct()


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (a, b): the smallest node it is connected to.

    Alternating large and small stars: each round is joins and sums over the links, never a component in one
    task, and the number of rounds grows with the logarithm of the longest path.
    """

    def directed(df: DataFrame) -> DataFrame:
        return df.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = store(directed(links), "links")
    before = state(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = store(directed(large), "links")
        lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
        small = edges.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = store(directed(small.union(lowest.select("a", "low"))), "links")
        if (after := state(edges)) == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def with_roots(classes: DataFrame) -> DataFrame:
    """``classes``, a stored table with distinct ``print``, with the ``root`` of the component of each."""
    roots = connected(ball_links(classes)).withColumnRenamed("node", "print")
    return classes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``doc_id`` that a document
    is connected to by fingerprints at most two bits apart. One row per row of ``docs``."""
    prints = store(fingerprints(docs, size), "prints")
    classes = store(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "classes")
    rooted = with_roots(classes)
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = store(rooted.join(lowest, "root").select("print", "component_id"), "components")
    return prints.join(known, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_rows(rows: DataFrame, size: int = 3) -> DataFrame:
    """The ``row`` of one row of each component: the one with the smallest ``doc_id`` (nulls last), of those the least ``row``.

    ``rows`` has a unique ``row``. Copies combine on the map side, by fingerprint and then by component, so that no task sees a group of them.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    prints = fingerprints(rows, size, ("row", "doc_id"))
    classes = store(prints.groupBy("print").agg(F.min(order).alias("first")), "classes")
    return with_roots(classes).groupBy("root").agg(F.min("first").alias("first")).select("first.row")
