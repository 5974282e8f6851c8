"""What the operators of this package share: words, tables, size-checked broadcasts, Arrow batches."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the word rule: what separates words. bytes.split() without arguments uses the same six.
SPACES = " \t\n\x0b\x0c\r"

BROADCAST_ROWS = 20_000
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
CACHE_WORDS = 250_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers of a local session find this package, whatever folder the session was started in.

    On a cluster the package is installed or submitted with the application.
    """
    sc, root = spark.sparkContext, str(Path(__file__).resolve().parents[2])
    if sc.applicationId in _shipped or not sc.master.startswith("local"):
        return
    _shipped.add(sc.applicationId)
    if root not in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='wirelark-')}/wirelark", "zip", root, "wirelark"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: few rows and bytes each, as one text can be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def word_array(text: Column) -> Column:
    """The words of ``text``; none for a null, empty or blank one.

    Splitting at one character takes a fraction of the time of a pattern.
    """
    spaced = F.coalesce(text, F.lit(""))
    for space in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, which the optimizer will not copy into the expressions that use them.

    A generator of one row separates the two projections.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(made)))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table, marked for broadcast if it is proven to have few rows; unchanged otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``text`` in lists from about ``size`` bytes each, so that a huge text needs little memory."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + size) if len(text) - start > size else None
        stop = gap.start() if gap else len(text)
        if words := text[start:stop].split():
            yield words
        start = stop


def own_names(df: DataFrame, own: Iterable[str]) -> DataFrame:
    """``df`` with its columns other than ``own`` renamed by place, so that they clash with nothing an operator adds.

    ``toDF`` with the former names brings them back.
    """
    own = set(own)
    return df.toDF(*[n if n in own else f"extra_{i}_" for i, n in enumerate(df.columns)])
