"""The alert chain on hand-made alerts."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from wirelark.config import AlertConfig, DetectionConfig, config_from_table
from wirelark.operators import alerts as al
from wirelark.schema import ALERTS
from wirelark.sources.sinks import fan_out, stream_alert_json, stream_fan_out, write_alert_json

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def alert(seq, seconds=0.0, kind="PORT_SCAN", severity=2, confidence=1.0, text="Port scan detected", source="10.0.0.1"):
    ts = T0 + datetime.timedelta(seconds=seconds)
    return (ts, seq, 2, kind, severity, text, source, "10.0.0.2", 1, 2, confidence)


def table(spark, rows):
    return spark.createDataFrame(rows, ALERTS)


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_identical_alerts_are_one(spark):
    assert seqs(al.dedupe(table(spark, [alert(1), alert(2)]))) == [1]
    assert seqs(al.dedupe(table(spark, [alert(1), alert(2)]), AlertConfig(enable_deduplication=False))) == [1, 2]


def test_next_bucket_counts_again(spark):
    rows = [alert(1, 299.9), alert(2, 300), alert(3, 301), alert(4, 10, source="10.0.0.9")]
    assert seqs(al.dedupe(table(spark, rows))) == [1, 2, 4]


def test_rate_limit_keeps_the_first_of_each_second(spark):
    rows = [alert(i, i / 150) for i in range(300)]
    kept = seqs(al.limit_rate(table(spark, rows), AlertConfig(max_alerts_per_second=100)))
    assert kept == [*range(100), *range(150, 250)]
    assert seqs(al.limit_rate(table(spark, rows))) == list(range(300))


def test_rate_limit_remembers_what_was_used(spark):
    rows = [alert(i, i / 1000) for i in range(10)]
    used = spark.createDataFrame([(T0, 7)], "second timestamp, used long")
    assert seqs(al.limit_rate(table(spark, rows), AlertConfig(max_alerts_per_second=9), used)) == [0, 1]


def test_duplicates_use_up_the_limit(spark):
    rows = [alert(i, i / 1000) for i in range(10)] + [alert(99, 0.5, source="10.0.0.7")]
    assert seqs(al.process(table(spark, rows), AlertConfig(max_alerts_per_second=10))) == [0]


@pytest.mark.parametrize("kind,confidence,severity", [
    ("SYN_FLOOD", 0.1, 3), ("ML_ANOMALY", 0.1, 3), ("PORT_SCAN", 0.1, 2), ("RATE_LIMIT_EXCEEDED", 0.1, 2),
    ("ANOMALOUS_TRAFFIC", 0.8, 1), ("ANOMALOUS_TRAFFIC", 0.81, 2), ("SUSPICIOUS_PAYLOAD", 0.8, 1),
    ("SUSPICIOUS_PAYLOAD", 0.81, 2), ("OTHER", 1.0, 1),
])
def test_severity_of_external_alerts(spark, kind, confidence, severity):
    low = al.with_severity(table(spark, [alert(1, kind=kind, severity=1, confidence=confidence)])).first()
    given = al.with_severity(table(spark, [alert(1, kind=kind, severity=4, confidence=confidence)])).first()
    assert (low.severity, given.severity) == (severity, 4)


def test_critical_is_counted(spark):
    counts = al.alert_severity_counts(table(spark, [alert(1, severity=4), alert(2, severity=4), alert(3, severity=1)]))
    assert {r.severity_name: r.alerts for r in counts.collect()} == {"LOW": 1, "MEDIUM": 0, "HIGH": 0, "CRITICAL": 2}


def test_risk_score(spark):
    scores = al.with_risk_score(table(spark, [alert(1, severity=4, confidence=0.5)])).first()
    assert scores.risk_score == 50.0


def test_json(spark):
    text = 'say "hi" \\ bye'
    row = al.alert_json(table(spark, [alert(1, 1.5, severity=4, confidence=0.95, text=text)])).first()
    assert row.json.startswith('{"timestamp":"2024-01-01T00:00:01Z","type":"PORT_SCAN","severity":"CRITICAL","description":')
    assert row.json.endswith('"source_port":1,"destination_port":2,"confidence_score":0.950}')
    assert json.loads(row.json)["description"] == text


def test_json_array_is_ordered(spark):
    rows = [alert(i, 0.001 * (i % 5), source=f"10.0.0.{i}") for i in range(20)]
    array = al.alert_json_array(table(spark, rows)).first()
    assert array.alerts == 20
    sources = [a["source_ip"] for a in json.loads(array.json)]
    assert sources == [f"10.0.0.{i}" for i in sorted(range(20), key=lambda i: (i % 5, i))]


def test_recent_and_retention(spark):
    rows = table(spark, [alert(i, i * 3600) for i in range(30)])
    assert [r.seq for r in al.recent_alerts(rows, 3).collect()] == [29, 28, 27]
    assert al.recent_alerts(rows, 5000, AlertConfig(recent_limit=7)).count() == 7
    assert seqs(al.retain(rows)) == list(range(5, 30))
    as_of = F.lit(T0 + datetime.timedelta(hours=40))
    assert seqs(al.retain(rows, as_of=as_of)) == list(range(16, 30))


def test_statistics(spark):
    rows = [alert(i, i / 10) for i in range(100)]
    row = al.alert_statistics(table(spark, rows), AlertConfig(max_alerts_per_second=4)).first()
    assert tuple(row) == (100, 1, 60, 39, 1 / 9)
    text = al.alert_statistics_json(table(spark, rows), AlertConfig(max_alerts_per_second=4)).first().json
    assert json.loads(text)["severity_counts"] == [0, 1, 0, 0]


def test_statistics_of_nothing(spark):
    assert tuple(al.alert_statistics(table(spark, [])).first()) == (0, 0, 0, 0, 0.0)


def test_fan_out_goes_on_after_a_failure(spark):
    seen = []

    def broken(df):
        raise ValueError("down")

    result = fan_out(table(spark, [alert(1)]), {"a": lambda df: seen.append(df.count()), "b": broken,
                                                "c": lambda df: seen.append(df.count())})
    assert seen == [1, 1] and result == {"a": None, "b": "down", "c": None}


def test_sinks(spark, tmp_path):
    rows = table(spark, [alert(1), alert(2, 86400)])
    write_alert_json(rows, str(tmp_path / "batch"))
    assert sorted(p.name for p in (tmp_path / "batch").glob("date=*")) == ["date=2024-01-01", "date=2024-01-02"]
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ALERTS).parquet(str(tmp_path / "in"))
    stream_alert_json(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    got = []
    stream_fan_out(stream, {"n": lambda df, batch: got.append((batch, df.count()))}, str(tmp_path / "c2")).awaitTermination()
    assert got == [(0, 2)]


def test_thresholds_table(spark):
    rows = spark.createDataFrame([("syn_flood_threshold", 7.0), ("z_score_threshold", 2.5), ("nonsense", 1.0)],
                                 "name string, value double")
    config = config_from_table(rows)
    assert config == DetectionConfig(syn_flood_threshold=7, z_score_threshold=2.5)
