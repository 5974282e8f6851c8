"""Settings that change with the time of the packets."""

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import NO_CHAIN, full, streamed
from tests.test_trackers import SECOND, START, frame, packet
from wirelark.config import DetectionConfig, versioned, versions_from_table
from wirelark.plans.detect import detect_all
from wirelark.streaming.detect import StreamDetector


def test_versions_from_a_table(spark):
    rows = [(10, "syn_flood_threshold", 5.0), (10, "syn_flood_threshold", 7.0), (20, "rule_based_enabled", 0.0), (5, "no such setting", 1.0), (30, "rule_based_enabled", 1.0)]
    table = spark.createDataFrame(rows, "after long, name string, value double").select(
        F.timestamp_micros(F.col("after") * SECOND).alias("valid_from"), "name", "value"
    )
    config = versions_from_table(table, DetectionConfig())
    assert config.syn_flood_threshold == 7 and config.rule_based_enabled and config.port_scan_threshold == 50
    assert config.pauses("rule_based_enabled") == [(20 * SECOND, 30 * SECOND)] and config.pauses("statistical_enabled") == []
    times = spark.range(0, 40, 5).select(F.timestamp_micros(F.col("id") * SECOND).alias("ts"), "id")
    assert [r[0] for r in times.select(config.limit("syn_flood_threshold")).collect()] == [100, 100, 7, 7, 7, 7, 7, 7]
    assert [r[0] for r in config.active(times, "rule_based_enabled").select("id").collect()] == [0, 5, 10, 15, 30, 35]
    assert versions_from_table(table.where("false")).limit("port_scan_window") is not None


def test_plain_settings_are_one_version(spark):
    config = DetectionConfig(rule_based_enabled=False)
    times = spark.range(3).select(F.timestamp_micros("id").alias("ts"))
    assert config.active(times, "rule_based_enabled").count() == 0 and config.active(times, "statistical_enabled").count() == 3


def test_windows_hold_for_a_run():
    with pytest.raises(ValueError, match="whole run"):
        versioned(DetectionConfig(), {0: {"port_scan_window": 5}})


def test_batch_and_stream_judge_by_the_packet_s_time(spark, tmp_path):
    """A micro-batch that holds packets of several versions, and packets of a pause, which no tracker counts."""
    base = DetectionConfig(syn_flood_threshold=15, syn_flood_window=60, statistical_enabled=False)
    changes = {1: {"rule_based_enabled": False}, 2: {"rule_based_enabled": True}, 3: {"syn_flood_threshold": 25}}
    config = versioned(base, {START + s * SECOND: c for s, c in changes.items()})
    df = full(frame(spark, [packet(i, i * 0.1) for i in range(45)]))
    # 10 before the pause, 10 within, so the 15th is number 24; from number 30 on (the 20th) 25 are needed.
    want = [*range(24, 30), *range(34, 45)]
    assert sorted(r.seq for r in detect_all(df, config).collect()) == want
    for cuts in ((), (5, 25), (12, 32)):
        part = sum((F.col("seq") >= c).cast("int") for c in cuts) if cuts else F.lit(0)
        folder = tmp_path / str(len(cuts) + sum(cuts))
        detector = StreamDetector(spark, str(folder / "tables"), config, NO_CHAIN)
        found = streamed(folder, detector, [df.where(part == n) for n in range(len(cuts) + 1)])
        assert sorted(r.seq for rows in found for r in rows) == want
