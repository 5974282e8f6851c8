"""Port scans by mergeable distinct sketches: sketches for all sources, exact sets for those near the threshold.

A HyperLogLog sketch of a source's destination ports in a window is a value of bounded size that is combined on the map side and
merged with others at any time, over tasks, tables and micro-batches. Its estimate says which sources can have reached the
threshold; only their ports are then counted exactly. With ``LOG_SIZE`` of 12 a sketch is exact but for hash collisions up to some
hundreds of ports, and its standard error beyond is 1.6 %; ``MARGIN`` is five of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.config import DetectionConfig
from wirelark.operators.traffic import is_port_carrier

LOG_SIZE = 12
MARGIN = 5 * 1.04 / 2 ** (LOG_SIZE / 2)
WINDOW = ["window_start", "source_ip"]


def windowed_ports(packets: DataFrame, seconds: int = 60) -> DataFrame:
    """``window_start``, ``source_ip`` and ``destination_port`` of the packets that have ports."""
    carrying = packets.where(is_port_carrier() & F.col("source_ip").isNotNull())
    start = F.timestamp_micros(F.floor(F.unix_micros("ts") / (seconds * 1_000_000)) * (seconds * 1_000_000))
    return carrying.select(start.alias("window_start"), "source_ip", "destination_port")


def port_sketches(ports: DataFrame) -> DataFrame:
    """A ``sketch`` per window and source."""
    return ports.groupBy(*WINDOW).agg(F.hll_sketch_agg("destination_port", F.lit(LOG_SIZE)).alias("sketch"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy(*WINDOW).agg(F.hll_union_agg("sketch").alias("sketch"))


def near_threshold(sketches: DataFrame, threshold: Column | int) -> DataFrame:
    """Windows and sources whose estimate does not rule out ``threshold`` distinct ports."""
    return sketches.where(F.hll_sketch_estimate("sketch") * (1 + MARGIN) >= threshold).select(*WINDOW)


def exact_scans(ports: DataFrame, near: DataFrame, threshold: Column | int) -> DataFrame:
    """Of the windows and sources ``near`` the threshold, those that reach it, with their number of ``ports``.

    Each port is one row per task when it is shuffled; the second grouping has at most 65,536 rows per window and source.
    """
    distinct = ports.join(near, WINDOW, "left_semi").groupBy(*WINDOW, "destination_port").agg(F.count("*").alias("packets"))
    return distinct.groupBy(*WINDOW).agg(F.count("*").alias("ports")).where(F.col("ports") >= threshold)


def sketched_port_scans(packets: DataFrame, config: DetectionConfig = DetectionConfig(), seconds: int = 60) -> DataFrame:
    """The sources of ``port_scan_windows``, found by sketches first. ``packets`` should be a table: it is scanned twice."""
    ports = windowed_ports(packets, seconds)
    near = near_threshold(port_sketches(ports), config.port_scan_threshold)
    return exact_scans(ports, near, config.port_scan_threshold)
