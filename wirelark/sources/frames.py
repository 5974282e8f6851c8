"""Captured frames from Parquet, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelark.config import CaptureConfig
from wirelark.schema import ETHER_IPV4, FRAMES

# Fixed meaning of the one capture filter that is a word instead of a condition.
FILTER_WORDS = {"ip": f"ether_type = {ETHER_IPV4}"}


def read_frames(spark: SparkSession, path: str, schema: T.StructType = FRAMES) -> DataFrame:
    """Captured frames. The schema is given, so no file is read to find it."""
    return spark.read.schema(schema).parquet(path)


def stream_frames(
    spark: SparkSession,
    path: str,
    schema: T.StructType = FRAMES,
    max_files_per_trigger: int | None = None,
    lateness: str | None = "10 seconds",
) -> DataFrame:
    """Frames (or, with their schema, packets) from a folder as files arrive, with a watermark on ``ts`` unless ``lateness`` is None."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(path)
    return rows.withWatermark("ts", lateness) if lateness else rows


def snap_truncate(frames: DataFrame, config: CaptureConfig = CaptureConfig()) -> DataFrame:
    """Frames cut to the first ``snap_length`` bytes; the length on the wire stays."""
    n = config.snap_length
    return frames.withColumns(
        {"frame": F.substring("frame", 1, n), "caplen": F.least(F.col("caplen"), F.lit(n)).cast("int")}
    )


def capture_filter(packets: DataFrame, config: CaptureConfig = CaptureConfig()) -> DataFrame:
    """Packets that the filter lets through: ``ip``, or any SQL condition over the packet columns.

    An empty filter lets everything through. The condition reaches the scan if packets are a table.
    """
    text = config.filter_expression.strip()
    return packets.where(FILTER_WORDS.get(text, text)) if text else packets
