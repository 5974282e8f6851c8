"""Packet sizes per source: rolling statistics and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.config import DetectionConfig
from wirelark.operators.alerts import alert
from wirelark.operators.ordered import rolling_totals
from wirelark.operators.traffic import with_moments
from wirelark.schema import ALERT_SUBJECT, ANOMALOUS_TRAFFIC, MEDIUM

# The first microsecond of the year 1: before any packet.
BEFORE_ALL_TIMES = -62_135_596_800_000_000


def size_rows(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("source_ip").isNotNull()).select(*ALERT_SUBJECT, "length")


def carried_sizes(before: DataFrame) -> DataFrame:
    """The rows that stand for ``lengths_before``, the lengths of the source that came before the packets, oldest first."""
    listed = before.select("source_ip", F.posexplode("lengths_before").alias("seq", "length"))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("destination_ip", "string"), ("source_port", "int"), ("destination_port", "int"))]
    return listed.select("source_ip", F.col("seq").cast("long"), F.timestamp_micros(F.lit(BEFORE_ALL_TIMES)).alias("ts"), "length", *nothing)


def rolling_size_stats(
    packets: DataFrame, config: DetectionConfig = DetectionConfig(), carried: DataFrame | None = None
) -> DataFrame:
    """Per packet: mean, population variance and standard deviation of the last packet lengths of its source,
    its own included, and its z-score (0 where the deviation is 0).

    ``carried`` are rows from before the packets (see ``carried_sizes``); they count but are not returned.
    """
    lengths = size_rows(packets)
    if carried is not None:
        lengths = lengths.withColumn("_new", F.lit(True)).unionByName(carried.withColumn("_new", F.lit(False)))
    stats = with_moments(
        rolling_totals(lengths, ["source_ip"], ["ts", "seq"], "length", config.moving_average_window)
    )
    z = F.when(F.col("stddev") == 0, F.lit(0.0)).otherwise(
        (F.col("length").cast("double") - F.col("mean")) / F.col("stddev")
    )
    scored = stats.withColumn("z_score", z)
    return scored if carried is None else scored.where("_new").drop("_new")


def size_zscore_alerts(
    packets: DataFrame, config: DetectionConfig = DetectionConfig(), carried: DataFrame | None = None
) -> DataFrame:
    stats = rolling_size_stats(packets, config, carried)
    unusual = stats.where(
        (F.col("samples") > config.limit("z_score_min_samples")) & (F.abs("z_score") > config.limit("z_score_threshold"))
    )
    text = F.format_string("Anomalous packet size from %s (z-score: %.6f)", "source_ip", "z_score")
    return alert(unusual, ANOMALOUS_TRAFFIC, MEDIUM, text)
