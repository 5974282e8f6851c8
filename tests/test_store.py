"""Tables whose scans leave out what a condition does not need; the newest alerts of a stream."""

import datetime

from pyspark.sql import functions as F

from tests.test_alerts import alert, table
from wirelark.config import AlertConfig, CaptureConfig
from wirelark.operators.alerts import recent_alerts, retain
from wirelark.schema import PACKETS
from wirelark.sources import derived
from wirelark.sources.frames import capture_filter
from wirelark.sources.store import AlertStore, write_clustered
from wirelark.streaming.recent import RecentAlerts


def scanned(df):
    """Rows that the scan of ``df`` handed on, after row groups were skipped."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.collectToPython()
        return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_conditions_skip_row_groups(spark, sf_dir, tmp_path):
    packets = derived.packets(spark, "/root/testdata/sf0.01").cache()
    plain, clustered = str(tmp_path / "plain"), str(tmp_path / "clustered")
    packets.repartition(8, "seq").write.parquet(plain)
    write_clustered(packets, clustered, files=8)
    n = packets.count()
    for condition, most in (("source_ip = '10.0.0.3'", 0.5), ("source_ip = '10.0.0.3' AND ts < '2024-01-01 00:01:00'", 0.4), ("source_port = 7", 0.0)):
        counts = []
        for path in (plain, clustered):
            stored = spark.read.schema(PACKETS).parquet(path)
            kept = capture_filter(stored, CaptureConfig(filter_expression=condition)).select("seq")
            assert kept.count() == packets.where(condition).count()
            counts.append(scanned(kept))
        assert counts[1] <= most * n and (counts[1] < counts[0] or counts[0] == 0)


def days(alerts):
    return sorted(str(r[0]) for r in alerts.read().select("date").distinct().collect())


def test_alert_store_prunes_and_drops_days(spark, tmp_path):
    alerts = AlertStore(spark, str(tmp_path / "store"))
    rows = table(spark, [alert(i, i * 6 * 3600) for i in range(40)])  # ten days, four alerts a day
    alerts.write(rows)
    config = AlertConfig(alert_retention=2 * 86400 + 3600)
    kept = alerts.retained(config)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and ">= 2024" in plan.split("PartitionFilters")[1].split("]")[0]
    assert kept.columns == rows.columns
    want = sorted(r.seq for r in retain(rows, config).collect())
    assert sorted(r.seq for r in kept.collect()) == want and len(want) == 9
    dropped = alerts.drop_old(config)
    assert len(dropped) == 7 and len(days(alerts)) == 3
    assert sorted(r.seq for r in alerts.read().collect()) == want
    assert alerts.drop_old(config) == [] and sorted(r.seq for r in alerts.retained(config).collect()) == want
    later = F.lit(datetime.datetime(2030, 1, 1)).cast("timestamp")
    assert len(alerts.drop_old(config, later)) == 3 and alerts.read().count() == 0
    assert alerts.retained(config).count() == 0 and alerts.drop_old(config) == []


def test_recent_alerts_equal_one_batch_after_every_part(spark, tmp_path):
    config = AlertConfig(recent_limit=12)
    recent = RecentAlerts(spark, str(tmp_path / "recent"), config)
    parts = [[alert(i, i) for i in range(20)], [], [alert(30, 5), alert(31, 500)], [alert(i, 100 + i % 3) for i in range(40, 60)]]
    so_far = []
    for number, part in enumerate(parts):
        for _ in range(2 if number == 2 else 1):  # a repeated micro-batch
            recent.add(table(spark, part), number)
        so_far += part
        like = table(spark, so_far)
        for count in (5, 100):
            got = [tuple(r) for r in recent.newest(number, like, count).collect()]
            assert got == [tuple(r) for r in recent_alerts(like, count, config).collect()] and len(got) <= 12
