"""Micro-batches against one batch, and the stream source."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.model import tracker_alerts
from tests.test_trackers import SECOND, START, frame, packet, random_packets
from wirelark.config import AlertConfig, DetectionConfig
from wirelark.operators import alerts as al
from wirelark.plans.detect import detect_all
from wirelark.schema import PACKETS
from wirelark.sources import derived
from wirelark.sources.frames import stream_frames
from wirelark.streaming import keyed
from wirelark.streaming.detect import StreamDetector
from wirelark.streaming.ledger import Ledger, hour

NO_CHAIN = AlertConfig(max_alerts_per_second=10**9, enable_deduplication=False)


def full(df):
    made = df.withColumns({"length": F.lit(100).cast("long"), "payload_length": F.lit(0).cast("long")})
    return made.select([F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PACKETS])


def streamed(folder, detector, parts):
    """The alerts of each part of the packets, which arrive one after the other, each as one micro-batch."""
    found = {}
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        source = stream_frames(part.sparkSession, f"{folder}/in", PACKETS)
        detector.run(source, lambda df, n: found.update({n: df.collect()}), f"{folder}/checkpoint").awaitTermination()
    return [found[n] for n in sorted(found)]


def test_chains_against_the_model():
    """Trackers of random times, in one go and in parts, against a walk packet by packet."""
    rng = random.Random(8)
    for _ in range(400):
        hop, now, rows = rng.choice([3, 10, 50]), 0, []
        for _ in range(rng.randint(1, 40)):
            now += rng.choice([1, 1, 2, 5, 9, hop, 2 * hop])
            n = rng.randint(1, 3)
            rows.append((now, n, rng.choice([0, 0, 1, n])))
        want, state = [], None
        for t, n, syns in rows:
            if state is None or t >= state[1] + hop:
                state = [t, t, 0, 0]
                want.append(state)
            if syns and not state[2]:
                state[1] = t
            state[2] += syns
            state[3] += n
        events = np.array(rows, np.int64)
        trackers, last = keyed.connection_chain(events, None, hop)
        assert [t[:2] for t in trackers] == [s[:2] for s in want] and last == tuple(want[-1])
        assert [t[2] for t in trackers] == [*(s[0] for s in want[1:]), keyed.NEVER]
        cut = rng.randint(0, len(rows))
        _, state = keyed.connection_chain(events[:cut], None, hop)
        assert keyed.connection_chain(events[cut:], state, hop)[1] == last
        starts, expected = keyed.scan_chain(events[:, 0], None, hop), []
        for t, *_ in rows:
            if not expected or t >= expected[-1] + hop:
                expected.append(t)
        assert [s[0] for s in starts[0]] == expected and starts[1] == expected[-1]


@pytest.mark.parametrize("cuts,statistics_window", [((60, 61, 200), 300), ((100,), 20)])
def test_trackers_across_batches(spark, tmp_path, cuts, statistics_window):
    packets = random_packets(5)
    config = DetectionConfig(
        syn_flood_threshold=3, syn_flood_window=30, connection_rate_threshold=6, connection_window=20,
        port_scan_threshold=4, statistics_window=statistics_window, statistical_enabled=False,
    )
    df = full(frame(spark, packets)).cache()
    part = sum((F.unix_micros("ts") >= START + c * SECOND).cast("int") for c in cuts)
    parts = [df.where(part == number) for number in range(len(cuts) + 1)]
    got = []
    for rows in streamed(tmp_path, StreamDetector(spark, str(tmp_path / "tables"), config, NO_CHAIN), parts):
        got += [(r.seq, r.type, int(r.description.split("(")[1].split()[0]) if "(" in r.description else None) for r in rows]
    want = tracker_alerts(packets, config)
    assert want and sorted(got) == want


def test_sizes_and_chain_across_batches(spark, sf_dir, tmp_path):
    """With small windows and limits that bite."""
    config = DetectionConfig(rule_based_enabled=False, moving_average_window=40, z_score_threshold=2.0)
    alerting = AlertConfig(max_alerts_per_second=1, dedup_window=60)
    packets = derived.packets(spark, sf_dir).cache()
    parts = [packets.where(F.expr(f"(unix_micros(ts) - {derived.EPOCH_US}) div 100500000 = {n}")) for n in range(3)]
    got = [r for rows in streamed(tmp_path, StreamDetector(spark, str(tmp_path / "tables"), config, alerting), parts) for r in rows]
    whole = detect_all(packets, config)
    want = al.process(whole, alerting).collect()
    assert len(want) < whole.count()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_failed_micro_batch_is_repeated(spark, tmp_path):
    """A sink that fails after the alert chain has left its facts: the repeated micro-batch gives the same alerts."""
    config = DetectionConfig(syn_flood_threshold=5, statistical_enabled=False)
    detector = StreamDetector(spark, str(tmp_path / "tables"), config, AlertConfig(max_alerts_per_second=8))
    df = full(frame(spark, [packet(i, i * 0.01, port=i % 3) for i in range(40)]))
    seen = []

    def sink(alerts, batch_id):
        seen.append((batch_id, sorted(r.seq for r in alerts.collect())))
        if len(seen) == 2:
            raise OSError("no such output")

    for part in ("seq < 10", "seq between 10 and 19", "seq >= 20"):
        df.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2 if "between" in part else 1):
            query = detector.run(stream_frames(spark, str(tmp_path / "in"), PACKETS), sink, str(tmp_path / "checkpoint"))
            try:
                query.awaitTermination()
            except Exception as error:  # noqa: BLE001
                assert "no such output" in str(error)
    # Ports 0, 1 and 2 make three signatures, all seen by the sixth alert; eight alerts a second are let through.
    assert seen == [(0, [4, 5, 6]), (1, []), (1, []), (2, [])]


def test_idle_sources_cost_nothing(spark, tmp_path):
    """Ten thousand sources that fall silent: later micro-batches read and write the state of the one that sends."""
    config = DetectionConfig(statistical_enabled=True)
    detector = StreamDetector(spark, str(tmp_path / "tables"), config, NO_CHAIN)
    many = spark.range(10_000).select(
        F.col("id").alias("seq"), F.timestamp_micros(F.lit(START) + F.col("id")).alias("ts"), F.concat(F.lit("s"), "id").alias("source_ip"),
        F.lit("TCP").alias("protocol"), F.lit(16).alias("tcp_flags"), F.lit(1).alias("destination_port"),
    )
    one = full(frame(spark, [packet(20_000 + i, 5 + i) for i in range(20)]))
    replies = []
    for part in (full(many), one, one):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        query = detector.run(stream_frames(spark, str(tmp_path / "in"), PACKETS), lambda df, n: df.count(), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        states = spark.read.parquet(str(tmp_path / "tables" / "rows" / f"slot={len(replies) % 2}")).where("state is not null").count()
        progress = query.lastProgress["stateOperators"][0]
        replies.append((states, progress["numRowsUpdated"], progress["numRowsTotal"]))
    assert [r[0] for r in replies] == [10_000, 1, 1]
    assert replies[0][1] >= 10_000 and replies[1][1] < 10 and replies[2][1] < 10 and replies[2][2] >= 10_001


def test_thresholds_can_change_between_batches(spark, tmp_path):
    settings = iter([DetectionConfig(statistical_enabled=False), DetectionConfig(statistical_enabled=False, syn_flood_threshold=5)])
    detector = StreamDetector(spark, str(tmp_path / "tables"), lambda: next(settings), NO_CHAIN)
    df = full(frame(spark, [packet(i, i * 0.01) for i in range(20)]))
    assert [len(rows) for rows in streamed(tmp_path, detector, [df.where("seq < 10"), df.where("seq >= 10")])] == [0, 10]


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), "k string, n long")
    hours = spark.createDataFrame([(0,), (1,)], "hour int")
    assert ledger.before(0, hours).count() == 0 and ledger.before(3, hours).count() == 0
    ledger.add(0, spark.createDataFrame([], "k string, n long, hour int"))
    assert ledger.before(1, hours).count() == 0
    some = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("c", 3, 2)], "k string, n long, hour int")
    ledger.add(1, some)
    ledger.add(1, some)
    ledger.add(2, some.where("k = 'a'"))
    rows = lambda batch, asked: sorted(tuple(r) for r in ledger.before(batch, asked).collect())
    assert rows(1, hours) == [] and rows(2, hours) == [("a", 1), ("b", 2)] and rows(3, hours) == [("a", 1), ("a", 1), ("b", 2)]
    assert "PartitionFilters: [isnotnull(batch" in ledger.before(3, hours)._jdf.queryExecution().toString()
    assert spark.range(1).select(hour(F.timestamp_micros(F.lit(7_200_000_000)))).first()[0] == 2


def test_one_file_per_trigger(spark, sf_dir, tmp_path):
    frames = derived.frames(spark, sf_dir)
    frames.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_frames(spark, str(tmp_path / "in"), max_files_per_trigger=1)
    seen = []
    query = (
        stream.writeStream.foreachBatch(lambda df, n: seen.append(df.count()))
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert len(seen) == 3 and sum(seen) == frames.count()


def test_families_off_and_on(spark, tmp_path):
    """A family or the duplicates off for some micro-batches: the state stays as it is and the stream goes on."""
    on, off = DetectionConfig(syn_flood_threshold=15, statistical_enabled=True), DetectionConfig(rule_based_enabled=False, statistical_enabled=False)
    detection = iter([on, off, on, on])
    detector = StreamDetector(spark, str(tmp_path / "tables"), lambda: next(detection), NO_CHAIN)
    df = full(frame(spark, [packet(i, i * 0.01) for i in range(40)]))
    found = streamed(tmp_path, detector, [df.where(f"seq div 10 = {number}") for number in range(4)])
    # 10 packets are seen before the pause; the fifth after it is the fifteenth.
    assert [sum(r.type == "SYN_FLOOD" for r in rows) for rows in found] == [0, 0, 6, 10]


def test_wrong_clock_of_one_source(spark, tmp_path):
    """A flood from the far future, most of a micro-batch, does not end the trackers of other sources."""
    config = DetectionConfig(syn_flood_threshold=15, syn_flood_window=30, statistical_enabled=False)
    packets = [packet(i, i * 0.1) for i in range(14)] + [packet(14 + i, 50_000 + i * 0.1, source="9.9.9.9") for i in range(5)] + [packet(19, 1.4)]
    packets += [packet(i, i * 0.1) for i in range(20, 25)]
    df = full(frame(spark, packets))
    parts = [df.where("seq < 14"), df.where("seq between 14 and 19"), df.where("seq >= 20")]
    got = [r.seq for rows in streamed(tmp_path, StreamDetector(spark, str(tmp_path / "tables"), config, NO_CHAIN, lateness=600), parts) for r in rows]
    want = [r.seq for r in detect_all(df, config).collect()]
    assert len(want) == 6 and sorted(got) == sorted(want)


def test_late_packets_are_older_trackers(spark, tmp_path):
    """Packets from before the tracker that is known: a flood among them is found, and that tracker's counts stay."""
    config = DetectionConfig(syn_flood_threshold=5, port_scan_threshold=4, statistics_window=10, port_scan_window=10, statistical_enabled=False)
    now = [packet(i, 100 + i * 0.1) for i in range(4)]
    late = [packet(10 + i, 50 + i * 0.1, port=i) for i in range(6)]
    rest = [packet(20, 100.5), packet(21, 100.6)]
    df = full(frame(spark, now + late + rest))
    parts = [df.where("seq < 10"), df.where("seq between 10 and 19"), df.where("seq >= 20")]
    got = streamed(tmp_path, StreamDetector(spark, str(tmp_path / "tables"), config, NO_CHAIN), parts)
    assert [sorted((r.seq, r.type) for r in rows) for rows in got] == [
        [], [(13, "PORT_SCAN"), (14, "PORT_SCAN"), (14, "SYN_FLOOD"), (15, "PORT_SCAN"), (15, "SYN_FLOOD")], [(20, "SYN_FLOOD"), (21, "SYN_FLOOD")]
    ]


def test_late_alerts_meet_old_limits_and_duplicates(spark, tmp_path):
    from tests.test_alerts import alert, table

    def batches(detector, parts):
        return [sum(1 for _ in detector.process(table(spark, rows), n).collect()) for n, rows in enumerate(parts)]

    limit = AlertConfig(max_alerts_per_second=2, enable_deduplication=False)
    late = [[alert(i) for i in range(3)], [alert(9, 700)], [alert(i + 20) for i in range(3)]]
    assert batches(StreamDetector(spark, str(tmp_path / "a"), alerting=limit), late) == [2, 1, 0]
    same = [[alert(1)], [alert(2, 1300)], [alert(3), alert(4)]]
    assert batches(StreamDetector(spark, str(tmp_path / "b")), same) == [1, 1, 0]
