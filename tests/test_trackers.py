"""Tracker rules against the plain Python model, and running totals under skew."""

import random

import pytest
from pyspark.sql import functions as F

from tests.model import rolling, tracker_alerts
from wirelark.config import DetectionConfig
from wirelark.operators import anchored, ordered, sizes

SECOND = 1_000_000
START = 1_704_067_200 * SECOND
SCHEMA = (
    "seq long, t long, source_ip string, destination_ip string, source_port int, destination_port int, "
    "protocol string, tcp_flags int"
)


def frame(spark, packets):
    rows = [
        (p["seq"], p["t"], p["source_ip"], "10.9.9.9", 1, p["destination_port"], p["protocol"], p["tcp_flags"])
        for p in packets
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("t")).drop("t")


def detected(spark, packets, config):
    df = frame(spark, packets)
    rows = anchored.flood_alerts(df, config).unionByName(anchored.detect_port_scan(df, config)).collect()
    ports = lambda text: int(text.split("(")[1].split()[0]) if "(" in text else None
    return sorted((r.seq, r.type, ports(r.description)) for r in rows)


def packet(seq, seconds, source="10.0.0.1", flags=2, port=80, protocol="TCP"):
    t = START + round(seconds * SECOND)
    return dict(seq=seq, t=t, source_ip=source, protocol=protocol, destination_port=port,
                tcp_flags=flags if protocol == "TCP" else None)


def random_packets(seed):
    rng = random.Random(seed)
    packets, seq = [], 0
    for number in range(24):
        now = rng.uniform(0, 100)
        quiet = rng.choice([0.01, 0.3, 3, 40])
        for _ in range(rng.randint(1, 90)):
            now += rng.choice([0, 0, rng.uniform(0, quiet), rng.uniform(0, quiet), rng.choice([0, 1, 60, 61, 300, 301, 302])
                               if rng.random() < 0.15 else 0.001])
            protocol = rng.choice(["TCP"] * 6 + ["UDP"] * 2 + ["ICMP"])
            flags = rng.choice([2, 18, 16, 16, 0]) if number % 3 else rng.choice([16] * 12 + [2])
            packets.append(packet(seq, now, f"10.0.0.{number}", flags, rng.randint(1, 12), protocol))
            seq += 1
    rng.shuffle(packets)
    return packets


@pytest.mark.parametrize("seed", range(4))
def test_random_packets(spark, seed):
    config = DetectionConfig(
        syn_flood_threshold=3, syn_flood_window=(1, 5, 30, 1)[seed], connection_rate_threshold=6,
        connection_window=(1, 2, 30, 60)[seed], port_scan_threshold=4,
        port_scan_window=(60, 60, 5, 1)[seed], statistics_window=(300, 10, 300, 3)[seed],
    )
    packets = random_packets(seed)
    want = tracker_alerts(packets, config)
    assert want and detected(spark, packets, config) == want


@pytest.mark.parametrize("window", [1, 7, 300])
def test_tracker_starts(spark, window):
    """Where trackers start, for many sources with different beginnings, rates and gaps."""
    rng = random.Random(window)
    packets, seq = [], 0
    for number in range(150):
        now = rng.uniform(0, 50) * window
        pace, syns = rng.choice([0.02, 0.2, 0.7, 1.5]) * window, rng.choice([0.02, 0.3, 0.9])
        for _ in range(rng.randint(1, 120)):
            now += rng.choice([rng.expovariate(1 / pace), 0, 1, window + 1]) if rng.random() < 0.9 else 9 * window
            packets.append(packet(seq, now, f"10.1.0.{number}", 2 if rng.random() < syns else 16))
            seq += 1
    config = DetectionConfig(statistics_window=window, port_scan_window=window)
    anchors, scans = {}, set()
    for source in {p["source_ip"] for p in packets}:
        mine = sorted((p["t"], p["tcp_flags"] == 2) for p in packets if p["source_ip"] == source)
        hop, end, scan_end = (window + 1) * SECOND, None, None
        start, syn = None, False
        for t, is_syn in mine:
            if end is None or t >= end:
                start, syn, end = t, False, t + hop
            if is_syn and not syn:
                syn, end = True, t + hop
            anchors[source, start] = end - hop
            if scan_end is None or t >= scan_end:
                scans.add((source, t))
                scan_end = t + hop
    connections = {(source, start, anchor) for (source, start), anchor in anchors.items()}
    df = frame(spark, packets)
    got = anchored.connection_trackers(anchored.tcp_times(df), config).collect()
    assert {(r.source_ip, r.t, r.anchor) for r in got} == connections and len(got) == len(connections)
    got = anchored.port_trackers(anchored.port_times(df), config).collect()
    assert {(r.source_ip, r.t) for r in got} == scans and len(got) == len(scans)


def test_shuffled_join_gives_the_same(spark):
    """With lookup tables that are too large to broadcast."""
    config = DetectionConfig(syn_flood_threshold=3, connection_rate_threshold=6, port_scan_threshold=4)
    packets = random_packets(9)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert detected(spark, packets, config) == tracker_alerts(packets, config)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges(spark):
    """Cases at the borders of the rules with the default settings, each with a source of its own."""
    many = [packet(i, i * 0.0101) for i in range(99)]
    ports = [packet(i, i * 0.1, port=i + 1, protocol="UDP") for i in range(49)]
    slow = [packet(i, i * 0.2, flags=16) for i in range(999)]
    cases = {
        "99 SYN": (many, []),
        "100th SYN in time": (many + [packet(99, 1.999999)], [(99, "SYN_FLOOD")]),
        "100th SYN too late": (many + [packet(99, 2.0)], []),
        "SYN-ACK counts": (many + [packet(99, 1.5, flags=18)], [(99, "SYN_FLOOD")]),
        "equal times follow seq": ([packet(i, 5) for i in reversed(range(101))], [(99, "SYN_FLOOD"), (100, "SYN_FLOOD")]),
        "49 ports": (ports, []),
        "50th port in time": (ports + [packet(49, 60.999999, port=50)], [(49, "PORT_SCAN")]),
        "50th port too late": (ports + [packet(49, 61, port=50)], []),
        "known port": (ports + [packet(49, 50, port=1)], []),
        "first SYN moves the anchor": (slow + [packet(999, 200)], [(999, "RATE_LIMIT_EXCEEDED")]),
        "no SYN, no move": (slow + [packet(999, 200, flags=16)], []),
        "idle source starts anew": (
            [packet(0, 0)] + [packet(i + 1, 301 + i * 0.01) for i in range(100)], [(100, "SYN_FLOOD")]),
        "not idle for long enough": ([packet(0, 0)] + [packet(i + 1, 300.9 + i * 0.0001) for i in range(100)], []),
    }
    packets = []
    for number, (case, _) in enumerate(cases.values()):
        packets += [dict(p, source_ip=f"10.0.1.{number}", seq=p["seq"] + 10_000 * number) for p in case]
    config = DetectionConfig()
    got = detected(spark, packets, config)
    assert got == tracker_alerts(packets, config)
    for number, (name, (_, want)) in enumerate(cases.items()):
        assert [(seq % 10_000, kind) for seq, kind, _ in got if seq // 10_000 == number] == want, name


@pytest.mark.parametrize("partitions", [1, 8])
def test_running_totals_of_a_hot_key(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot" if i % 3 else f"k{i % 7}", i // 4, i, rng.randint(0, 9)) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, ts long, seq long, v long").repartition(partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps small ranges apart
    try:
        got = ordered.running_totals(df, ["k"], ["ts", "seq"], ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sums, want = {}, {}
    for k, _, seq, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        sums[k] = sums.get(k, 0) + v
        want[seq] = sums[k]
    assert {r.seq: r.v for r in got} == want


@pytest.mark.parametrize("window,block", [(1, 1), (10, 64), (1000, 1000)])
def test_rolling_totals_across_blocks(spark, window, block):
    rng = random.Random(window)
    rows = [("hot" if i % 4 else f"k{i % 5}", i, rng.randint(40, 1500)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = {r.seq: (r.n, r.s, r.q) for r in ordered.rolling_totals(df, ["k"], ["seq"], "v", window, block).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        want.update(zip([r[1] for r in mine], rolling([r[2] for r in mine], window), strict=True))
    assert got == want


def sized(spark, lengths):
    rows = [(i, START + i, "10.0.0.1", "10.0.0.2", 1, 2, n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(
        rows, "seq long, t long, source_ip string, destination_ip string, source_port int, destination_port int, length long"
    )
    return sizes.size_zscore_alerts(df.withColumn("ts", F.timestamp_micros("t")))


@pytest.mark.parametrize("lengths,alerts", [
    ([100] * 10 + [900], 1),
    ([100] * 9 + [900], 0),
    ([100] * 50, 0),
    ([9000] + [100] * 1000 + [101], 1),
])
def test_zscore_edges(spark, lengths, alerts):
    assert sized(spark, lengths).count() == alerts
