"""Port scans by sketches against exact counts."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import full
from tests.test_trackers import START, frame, packet
from wirelark.config import DetectionConfig
from wirelark.operators import sketches
from wirelark.operators.traffic import port_scan_windows
from wirelark.schema import PACKETS
from wirelark.sources.frames import stream_frames
from wirelark.streaming.scans import StreamedScans


def scans(df):
    return sorted(tuple(r) for r in df.select("window_start", "source_ip", "ports").collect())


@pytest.mark.parametrize("threshold", [1, 50, 400, 3000, 20_000])
def test_no_scan_is_missed(spark, threshold):
    """Sources just below, at and above the threshold, each port several times: whoever reaches it is near it."""
    counts = [max(1, round(threshold * f)) for f in (0.5, 0.9, 0.99, 1, 1, 1, 1, 1.001, 1.01, 1.05, 1.2)]
    rng = random.Random(threshold)
    parts = None
    for number, n in enumerate(counts * 3):
        step = rng.choice([1, 3, 7, 11])
        part = spark.range(n * 2).select(
            F.lit(f"10.0.{number}").alias("source_ip"), ((F.col("id") % n * step + number) % 65536).cast("int").alias("destination_port"),
        )
        parts = part if parts is None else parts.unionByName(part)
    ports = parts.withColumn("window_start", F.timestamp_micros(F.lit(START))).repartition(8)
    near = sketches.near_threshold(sketches.port_sketches(ports), threshold)
    exact = ports.groupBy("source_ip").agg(F.count_distinct("destination_port").alias("ports")).where(F.col("ports") >= threshold)
    assert exact.count() >= 20 and exact.join(near, "source_ip", "left_anti").count() == 0
    assert sketches.exact_scans(ports, near, threshold).count() == exact.count()
    if threshold > 1:  # half the threshold is ruled out without counting
        assert near.count() < len(counts) * 3


def test_edges(spark):
    config = DetectionConfig(port_scan_threshold=3)
    none = full(frame(spark, [packet(0, 0)])).withColumn("source_ip", F.lit(None).cast("string"))
    assert scans(sketches.sketched_port_scans(none, config)) == []
    df = full(frame(spark, [packet(i, i * 25, port=i, protocol=("UDP", "TCP")[i % 2]) for i in range(9)] + [packet(9, 0, port=77, protocol="ICMP")]))
    assert scans(sketches.sketched_port_scans(df, config)) == scans(port_scan_windows(df, config)) != []


def test_merged_over_micro_batches(spark, tmp_path):
    """Ports of a window that come in several micro-batches, late ones among them, and one that is repeated."""
    config = DetectionConfig(port_scan_threshold=5)
    rng = random.Random(2)
    rows = [packet(i, rng.uniform(0, 200), f"10.0.0.{rng.randrange(6)}", port=rng.randrange(1, 9)) for i in range(400)]
    df = full(frame(spark, rows)).cache()
    streamed, found = StreamedScans(spark, str(tmp_path / "tables"), config), {}
    for number in range(4):
        df.where(F.col("seq") % 4 == number).write.mode("append").parquet(str(tmp_path / "in"))
        source = stream_frames(spark, str(tmp_path / "in"), PACKETS)
        streamed.run(source, lambda got, n: found.update({(*r[:2],): r[2] for r in got.collect()}), str(tmp_path / "c")).awaitTermination()
    want = scans(port_scan_windows(df, config))
    assert want and sorted((*k, n) for k, n in found.items()) == want
    again = streamed.found(df.where(F.col("seq") % 4 == 3), 3)
    assert {(*r[:2],) for r in again.collect()} <= {w[:2] for w in want}
    assert streamed.found(df.where("false"), 4).count() == 0
