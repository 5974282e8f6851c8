"""Every operator as a query over the given tables, with SQL to check it against.

Packets, and from them frames and alerts, are derived by Spark from ``events`` (see
``wirelark.sources.derived``), whole, and stored as tables on first use in a session, as a capture would
leave them. The queries read those tables.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pyarrow.compute as pc  # noqa: E402
from pyspark.ml import Pipeline as MlPipeline  # noqa: E402
from pyspark.ml.feature import MinMaxScaler, VectorAssembler  # noqa: E402
from pyspark.sql import DataFrame, Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.streaming import StreamingQuery  # noqa: E402

import oracles  # noqa: E402
from wirelark.config import AlertConfig, CaptureConfig, DetectionConfig, versions_from_table  # noqa: E402
from wirelark.operators import alerts as al  # noqa: E402
from wirelark.operators import anchored, audit, decode, rules, scoring, sizes, sketches, traffic  # noqa: E402
from wirelark.plans.detect import detect_all, detection_statistics  # noqa: E402
from wirelark.plans.pipeline import Pipeline, end_to_end, packets_of  # noqa: E402
from wirelark.schema import PACKETS, TCP_FLAGS  # noqa: E402
from wirelark.session import shared_folder, store  # noqa: E402
from wirelark.sources import derived  # noqa: E402
from wirelark.sources.frames import capture_filter, read_frames, snap_truncate, stream_frames  # noqa: E402
from wirelark.sources.sinks import fan_out, write_alert_json  # noqa: E402
from wirelark.sources.store import AlertStore, write_clustered  # noqa: E402
from wirelark.streaming.chain import AlertChain  # noqa: E402
from wirelark.streaming.detect import StreamDetector  # noqa: E402
from wirelark.streaming.recent import RecentAlerts  # noqa: E402
from wirelark.streaming.scans import StreamedScans  # noqa: E402

try:  # the training-data operators are a part that can be taken away, and so can the packages that they need
    import corpus_pipeline
    from wirelark.llm import entries as llm
except ModuleNotFoundError as missing:
    if (missing.name or "").startswith("wirelark") and missing.name != "wirelark.llm":
        raise
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]

# The defaults suit denser traffic than the test tables hold, at which most rules would find nothing.
DETECTION = DetectionConfig(
    syn_flood_threshold=20, syn_flood_window=30, connection_rate_threshold=40, connection_window=30,
    enable_ml_inference=True,
)
WINDOWED = DetectionConfig(syn_flood_threshold=5, connection_rate_threshold=6)
ALERTING = AlertConfig(max_alerts_per_second=50)
MODEL = scoring.logistic()

_stored: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Query) -> DataFrame:
    """The table ``name``, stored on first use in this session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = store(make(spark, sf_dir), name)
    return _stored[key]


def _spread(make: Query) -> Query:
    """The test table is one file that one task reads; its offspring are written by all tasks, as files
    that can be read in parallel."""
    return lambda spark, sf_dir: make(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _once(spark, sf_dir, "packets", _spread(derived.packets))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _once(spark, sf_dir, "frames", _spread(derived.frames))


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _once(spark, sf_dir, "damaged", _spread(derived.damaged_frames))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    made = _once(spark, sf_dir, "alerts", lambda s, d: detect_all(_packets(s, d), DETECTION, MODEL))
    return made.withColumn("confidence_score", F.round("confidence_score", 9))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/out/{name}-{uuid.uuid4().hex}"


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the SQL side has them (the session runs in UTC)."""
    return df.select(
        [F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else f.name for f in df.schema]
    )


def _over(source: Query, operator: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: _plain(operator(source(spark, sf_dir), *args))


def _digested(frames: DataFrame) -> DataFrame:
    """Frames with a digest of their bytes, without the two checksums, which have audits of their own."""
    tcp = F.hex(F.substring("frame", 24, 1)) == "06"
    rest = F.when(tcp, F.expr("substring(frame, 27, 24) || substring(frame, 53)")).otherwise(F.expr("substring(frame, 27)"))
    return frames.withColumn("frame", F.md5(F.concat(F.substring("frame", 1, 24), rest)))


def _read_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _frames(spark, sf_dir).inputFiles()[0].rsplit("/", 1)[0]
    return _plain(_digested(read_frames(spark, path)))


def _snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = snap_truncate(_frames(spark, sf_dir), CaptureConfig(snap_length=60))
    return _plain(cut.select("seq", "ts", "caplen", "length", F.length("frame").alias("frame_bytes")))


def _filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = capture_filter(decode.decode_frames(_damaged(spark, sf_dir)), CaptureConfig(filter_expression="ip"))
    return kept.groupBy("protocol").agg(F.count("*").alias("packets"))


HEADERS = {
    "ethernet": ["dst_mac", "src_mac", "ether_type"],
    "ip": [
        "version", "ihl", "tos", "total_length", "identification", "flags", "fragment_offset", "ttl", "protocol", "checksum",
        "source_ip", "destination_ip",
    ],
    "tcp": [
        "source_port", "destination_port", "sequence_number", "acknowledgment_number", "data_offset", "flags", "window_size",
        "urgent_pointer",
    ],
    "udp": ["source_port", "destination_port", "length", "checksum"],
}


def _headers(frames: DataFrame) -> DataFrame:
    fields = [F.col(f"{header}.{name}").alias(f"{header}_{name}") for header, names in HEADERS.items() for name in names]
    return decode.with_headers(frames).select("seq", *fields)


def _tcp_to_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own capture condition over the packet columns."""
    condition = "protocol = 'TCP' AND destination_port < 1024 AND tcp_flags & 2 <> 0"
    kept = capture_filter(decode.decode_frames(_frames(spark, sf_dir)), CaptureConfig(filter_expression=condition))
    return kept.groupBy("source_ip", "destination_port").agg(F.count("*").alias("packets"))


def _json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "alert-json")
    write_alert_json(_alerts(spark, sf_dir), path)
    return spark.read.schema("value string, date date").text(path).select("date", F.col("value").alias("json"))


def _fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, severe = _folder(spark, "archive"), _folder(spark, "severe")

    def broken(_: DataFrame) -> None:
        raise OSError("no such output")

    fan_out(
        _alerts(spark, sf_dir),
        {
            "archive": lambda df: df.write.parquet(archive),
            "broken": broken,
            "severe": lambda df: df.where("severity >= 3").write.parquet(severe),
        },
    )
    counts = [
        spark.read.parquet(path).agg(F.lit(name).alias("output"), F.count("*").alias("alerts"))
        for name, path in (("archive", archive), ("severe", severe))
    ]
    return counts[0].unionByName(counts[1])


def _features(packets: DataFrame) -> DataFrame:
    vector = scoring.feature_vector(packets)
    return vector.select("seq", "ts", *[F.col("features")[i].cast("double").alias(f"f{i + 1}") for i in range(8)])


def _score(packets: DataFrame) -> DataFrame:
    return scoring.ml_score(packets, MODEL).select("seq", "ts", F.round("score", 9).alias("score"))


def _ml_alerts(packets: DataFrame) -> DataFrame:
    found = scoring.ml_anomaly_alerts(packets, MODEL, DETECTION)
    return found.withColumn("confidence_score", F.round("confidence_score", 9))


def _all(packets: DataFrame) -> DataFrame:
    return detect_all(packets, DETECTION, MODEL).withColumn("confidence_score", F.round("confidence_score", 9))


def _detection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = _packets(spark, sf_dir)
    return detection_statistics(packets, detect_all(packets, DETECTION, MODEL))


def _severity(alerts: DataFrame) -> DataFrame:
    """Alerts as handed in from outside: without a severity, with some confidence."""
    external = alerts.withColumns(
        {"severity": F.lit(1), "confidence_score": (F.col("seq") % 6 + 5).cast("double") / 10}
    )
    return al.with_severity(external).select(*al.ALERT_ORDER, "type", "confidence_score", "severity")


def _stages(packets: DataFrame) -> DataFrame:
    def count_by(key: str) -> Callable[[DataFrame], DataFrame]:
        return lambda df: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("packets"))

    pipeline = (
        Pipeline()
        .add_stage("protocols", count_by("protocol"))
        .add_stage("talkers", count_by("source_ip"))
        .add_stage("large", lambda df: count_by("source_ip")(df.where("payload_length > 1500")))
    )
    parts = [df.select(F.lit(name).alias("stage"), "key", "packets") for name, df in pipeline.outputs(packets).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _stage_statistics(packets: DataFrame) -> DataFrame:
    def needs_ports(packet) -> None:
        if packet.destination_port == 0:
            raise ValueError("no ports")

    pipeline = Pipeline().add_packet_function("needs_ports", needs_ports).add_packet_function("any", lambda packet: None)
    return pipeline.statistics(packets.select("seq", "destination_port")).drop("average_processing_time_ms")


def _live_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of ``stage_statistics`` by functions of Arrow columns, counted by the job that writes the packets."""
    packets = _packets(spark, sf_dir).select("seq", "destination_port")
    pipeline = (
        Pipeline()
        .add_batch_function("needs_ports", lambda ports: pc.equal(ports, 0), ["destination_port"])
        .add_batch_function("any", lambda seq: None, ["seq"])
    )
    metrics = Observation()
    pipeline.observed(packets, metrics).write.parquet(_folder(spark, "observed"))
    return pipeline.live_statistics(packets, metrics).drop("average_processing_time_ms")


@F.udtf(returnType="flag string, bit int")
class _FlagRows:
    """A row per TCP flag of a packet."""

    def eval(self, flags: int):
        for name, bit in TCP_FLAGS.items():
            if flags and flags & bit:
                yield name, bit


def _emitted(packets: DataFrame) -> DataFrame:
    pipeline = Pipeline().add_emitter("flags", _FlagRows, ["tcp_flags"])
    return pipeline.emitted(packets, ["source_ip"])["flags"].groupBy("source_ip", "flag", "bit").agg(F.count("*").alias("packets"))


def _pipeline_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a fitted MLlib pipeline: how large a payload is between the smallest and the largest of all packets."""
    packets = _packets(spark, sf_dir)
    vector, names = scoring.features(), scoring.feature_columns()
    seen = packets.select(*[vector[i].cast("double").alias(n) for i, n in enumerate(names)])
    stages = [VectorAssembler(inputCols=names, outputCol="features"), MinMaxScaler(inputCol="features", outputCol="scaled")]
    model = scoring.PipelineScore(MlPipeline(stages=stages).fit(seen), "scaled", names.index("feature_payload_length"))
    return _plain(scoring.ml_score(packets, model).select("seq", "ts", F.round("score", 9).alias("score")))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture condition over packets that are stored for it."""
    path = _folder(spark, "clustered")
    write_clustered(_packets(spark, sf_dir), path)
    condition = "source_ip = '10.0.0.3' AND destination_ip = '192.168.1.3' AND destination_port BETWEEN 1 AND 20"
    kept = capture_filter(spark.read.schema(PACKETS).parquet(path), CaptureConfig(filter_expression=condition))
    return kept.groupBy("destination_port", "protocol").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


def _alert_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a minute, each moved back by a day per eighth of them, from a store that has dropped older days."""
    moved = _alerts(spark, sf_dir).withColumn("ts", F.col("ts") - F.make_dt_interval(days=(F.col("seq") % 8).cast("int")))
    alerts = AlertStore(spark, _folder(spark, "alert-store"))
    alerts.write(moved)
    kept = AlertConfig(alert_retention=3 * 86400)
    alerts.drop_old(kept)
    return _plain(alerts.retained(kept))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(traffic.capture_rates(_frames(spark, sf_dir), derived.capture_counters(spark, sf_dir)))


def _stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams, frames and counters, that meet by interface and time."""
    frames, counters = _frames(spark, sf_dir), _once(spark, sf_dir, "counters", derived.capture_counters)
    out, samples, checkpoint = (_folder(spark, f"rates-{n}") for n in ("out", "counters", "checkpoint"))
    cut_at = F.expr(f"least((unix_micros(ts) - {derived.EPOCH_US}) div 87000000, 2)")
    arrived = []

    def run(inbox: str) -> StreamingQuery:
        number, last = len(arrived), F.max("ts") + F.expr("interval 1 hour")
        arrived.append(inbox)
        if number < 3:
            counters.where(cut_at == number).write.mode("append").parquet(samples)
        else:  # the counters' clock goes on as well
            beat = counters.agg(last.alias("ts"), F.lit("none").alias("interface_name"), F.lit(0).cast("long").alias("dropped"))
            beat.withColumn("if_dropped", F.col("dropped")).select(*counters.columns).write.mode("append").parquet(samples)
        met = traffic.capture_rates(stream_frames(spark, inbox, lateness=None), stream_frames(spark, samples, counters.schema))
        return met.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)

    _replay(frames, "rates", run, LONE_FRAME)
    return _plain(spark.read.schema(_rates_schema(spark, sf_dir)).parquet(out).where("interface_name <> 'none'"))


def _rates_schema(spark: SparkSession, sf_dir: str):
    return traffic.capture_rates(_frames(spark, sf_dir), derived.capture_counters(spark, sf_dir)).schema


def _stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, checkpoint = _alerts(spark, sf_dir), _folder(spark, "recent-checkpoint")
    recent = RecentAlerts(spark, _folder(spark, "recent"))
    last = _replay(alerts, "recent", lambda inbox: recent.run(stream_frames(spark, inbox, alerts.schema), checkpoint))
    return _plain(recent.newest(last.lastProgress["batchId"], alerts))


def _thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([("syn_flood_threshold", 5.0)], "name string, value double")
    return _plain(traffic.judge_rates(_packets(spark, sf_dir), table))


# Settings that change while packets come: seconds after the first packet, name, value.
CHANGES = [
    (60, "syn_flood_threshold", 10.0), (60, "port_scan_threshold", 40.0), (60, "connection_rate_threshold", 60.0), (100, "rule_based_enabled", 0.0),
    (130, "rule_based_enabled", 1.0), (130, "connection_rate_threshold", 30.0), (130, "z_score_threshold", 2.5), (130, "payload_size_threshold", 4000.0),
    (170, "enable_ml_inference", 0.0), (180, "statistical_enabled", 0.0), (200, "statistical_enabled", 1.0), (200, "z_score_min_samples", 200.0),
    (210, "syn_flood_threshold", 25.0), (210, "enable_ml_inference", 1.0), (210, "anomaly_confidence_threshold", 0.9),
]


def _versions(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CHANGES, "after int, name string, value double")
    return rows.select(F.timestamp_micros(F.col("after") * 1_000_000 + F.lit(derived.EPOCH_US)).alias("valid_from"), "name", "value")


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = versions_from_table(_versions(spark), DETECTION)
    found = detect_all(_packets(spark, sf_dir), config, MODEL)
    return _plain(found.withColumn("confidence_score", F.round("confidence_score", 9)))


def _capture_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.capture_statistics(_frames(spark, sf_dir), derived.capture_counters(spark, sf_dir))


def _end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(end_to_end(_frames(spark, sf_dir), DETECTION, ALERTING, model=MODEL))


# Streams: the table arrives in parts of 87 seconds each, and the query is run on what is new after each part.


# A single SYN packet, which is below every threshold, and a frame that is no IPv4.
LONE_PACKET = {"protocol": "'TCP'", "tcp_flags": "2", "source_ip": "'0.0.0.0'"}
LONE_FRAME = {"frame": "unhex('025a107ec431025a107e88060806')", "caplen": "14", "length": "14", "interface_name": "'none'"}


def _replay(rows: DataFrame, name: str, run: Callable[[str], StreamingQuery], heartbeat: dict[str, str] | None = None) -> StreamingQuery:
    """Write ``rows`` to a folder part by part, running ``run(folder)`` after each.

    ``heartbeat`` is a row (columns as SQL) that is added twice, an hour later: the first time it moves the watermark past all windows,
    the second, in a run of its own, it makes the stream act on it.
    """
    spark = rows.sparkSession
    inbox = _folder(spark, f"{name}-in")
    part = F.least(F.expr(f"(unix_micros(ts) - {derived.EPOCH_US}) div 87000000"), F.lit(2))
    for number in range(3):
        rows.where(part == number).write.mode("append").parquet(inbox)
        query = run(inbox)
        query.awaitTermination()
    for _ in range(2 if heartbeat else 0):
        last = rows.agg((F.max("ts") + F.expr("interval 1 hour")).alias("ts"))
        beat = {"ts": F.col("ts"), **{name: F.expr(text) for name, text in heartbeat.items()}}
        last.select([beat.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode("append").parquet(inbox)
        query = run(inbox)
        query.awaitTermination()
    return query


def _stream(
    spark: SparkSession, rows: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame], heartbeat: dict[str, str] | None = None
) -> DataFrame:
    """The rows that the streaming ``transform`` of ``rows`` has written when all parts have arrived."""
    out, checkpoint = _folder(spark, f"{name}-out"), _folder(spark, f"{name}-checkpoint")

    def run(inbox: str) -> StreamingQuery:
        result = transform(stream_frames(spark, inbox, rows.schema))
        writer = result.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(availableNow=True).start(out)

    _replay(rows, name, run, heartbeat)
    schema = transform(rows).schema
    return _plain(spark.read.schema(schema).parquet(out))


def _stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, _frames(spark, sf_dir), "frames", _digested)


def _stream_windows(operator: Callable[..., DataFrame], name: str) -> Query:
    return lambda spark, sf_dir: _stream(
        spark, _packets(spark, sf_dir), name, lambda df: operator(df, WINDOWED), LONE_PACKET
    )


def _batches(
    spark: SparkSession, rows: DataFrame, name: str, start: Callable[[DataFrame, Callable[[DataFrame, int], None], str], StreamingQuery],
) -> DataFrame:
    """What ``start(stream, sink, checkpoint)`` has given to its sink when all parts of ``rows`` have arrived."""
    out, checkpoint = _folder(spark, f"{name}-out"), _folder(spark, f"{name}-checkpoint")

    def sink(found: DataFrame, batch_id: int) -> None:
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _replay(rows, name, lambda inbox: start(stream_frames(spark, inbox, rows.schema), sink, checkpoint))
    return spark.read.parquet(out).drop("batch")


def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates across micro-batches, without a limit: all columns of the alerts."""
    chain = AlertChain(spark, _folder(spark, "dedup-tables"), AlertConfig(max_alerts_per_second=1 << 31))
    return _plain(_batches(spark, _alerts(spark, sf_dir), "dedup", chain.run))


def _stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit, duplicates and severity across micro-batches."""
    chain = AlertChain(spark, _folder(spark, "chain-tables"), ALERTING)
    return _plain(_batches(spark, _alerts(spark, sf_dir), "chain", chain.run))


def _stream_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = StreamedScans(spark, _folder(spark, "scan-tables"), WINDOWED)
    found = _batches(spark, _packets(spark, sf_dir), "scans", scans.run)
    return _plain(found.groupBy("window_start", "source_ip").agg(F.max("ports").alias("ports")))


def _stream_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection on a stream under settings that change with the time of the packets."""
    no_chain = AlertConfig(max_alerts_per_second=1 << 31, enable_deduplication=False)
    detector = StreamDetector(
        spark, _folder(spark, "versions-state"), lambda: versions_from_table(_versions(spark), DETECTION), no_chain, MODEL
    )
    found = _batches(spark, _packets(spark, sf_dir), "versions", detector.run)
    return _plain(found.withColumn("confidence_score", F.round("confidence_score", 9)))


def _stream_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    out, checkpoint = _folder(spark, "e2e-out"), _folder(spark, "e2e-checkpoint")
    detector = StreamDetector(spark, _folder(spark, "e2e-state"), DETECTION, ALERTING, MODEL)

    def sink(alerts: DataFrame, batch_id: int) -> None:
        al.alert_json(alerts).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def run(inbox: str) -> StreamingQuery:
        return detector.run(stream_frames(spark, inbox), sink, checkpoint, packets_of)

    _replay(frames, "e2e", run)
    return _plain(spark.read.parquet(out).drop("batch"))


def entry(spark: SparkSession) -> DataFrame:
    """Frames to alert documents on the smallest tables: decode, detect, limit, deduplicate, format."""
    return _end_to_end(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {
        # sources and sinks
        "read_frames": _read_frames,
        "snap_truncate": _snap,
        "capture_filter": _filter,
        "capture_predicate": _tcp_to_web,
        "clustered_predicate": _clustered,
        "alert_json_sink": _json_sink,
        "alert_fanout": _fanout,
        # decode
        "decode_frames": _over(_frames, packets_of),
        "decode_headers": _over(_frames, _headers),
        "decode_failures": _over(_damaged, decode.decode_failures),
        "protocol_mix": _over(_packets, traffic.protocol_mix),
        "tcp_flag_counts": _over(_packets, traffic.tcp_flag_counts),
        "packet_summary": _over(_packets, decode.packet_summary),
        "validate_packets": _over(_damaged, decode.validate_packets),
        "ip_checksum_audit": _over(_frames, audit.ip_checksum_audit),
        "tcp_checksum_audit": _over(_frames, audit.tcp_checksum_audit),
        "feature_vector": _over(_packets, _features),
        "suspicious_payload": _over(_packets, rules.suspicious_payload),
        # counts and rates
        "packet_statistics": _over(_packets, traffic.packet_statistics),
        "capture_statistics": _capture_statistics,
        "capture_rates": _rates,
        "syn_rate_windows": _over(_packets, traffic.syn_rate_windows, WINDOWED),
        "port_scan_windows": _over(_packets, traffic.port_scan_windows, WINDOWED),
        "sketched_port_scans": _over(_packets, sketches.sketched_port_scans, WINDOWED),
        "connection_rate_windows": _over(_packets, traffic.connection_rate_windows, WINDOWED),
        "packet_rate_series": _over(_packets, traffic.packet_rate_series),
        "detection_statistics": _detection_statistics,
        # detectors
        "detect_syn_flood": _over(_packets, anchored.detect_syn_flood, DETECTION),
        "detect_port_scan": _over(_packets, anchored.detect_port_scan, DETECTION),
        "detect_connection_flood": _over(_packets, anchored.detect_connection_flood, DETECTION),
        "rolling_size_stats": _over(_packets, sizes.rolling_size_stats),
        "size_zscore_alerts": _over(_packets, sizes.size_zscore_alerts),
        "ml_score": _over(_packets, _score),
        "ml_anomaly_alerts": _over(_packets, _ml_alerts),
        "ml_pipeline_score": _pipeline_model,
        "state_expiry": _over(_packets, anchored.active_trackers, DETECTION),
        "detect_all": _over(_packets, _all),
        # alert chain
        "alert_rate_limit": _over(_alerts, al.limit_rate, ALERTING),
        "alert_dedup": _over(_alerts, lambda a: al.dedupe(al.limit_rate(a, ALERTING), ALERTING)),
        "alert_severity": _over(_alerts, _severity),
        "alert_risk_score": _over(_alerts, lambda a: al.with_risk_score(a).select(*al.ALERT_ORDER, "risk_score")),
        "recent_alerts": _over(_alerts, al.recent_alerts),
        "alert_retention": _over(_alerts, al.retain, AlertConfig(alert_retention=60)),
        "alert_store": _alert_store,
        "alert_json": _over(_alerts, al.alert_json),
        "alert_json_array": _over(_alerts, al.alert_json_array, 40),
        "alert_statistics": _over(_alerts, al.alert_statistics, ALERTING),
        "alert_severity_counts": _over(_alerts, al.alert_severity_counts),
        "alert_statistics_json": _over(_alerts, al.alert_statistics_json, ALERTING),
        # stages, settings, the whole way
        "stage_pipeline": _over(_packets, _stages),
        "stage_statistics": _over(_packets, _stage_statistics),
        "stage_live_statistics": _live_statistics,
        "stage_emitted_rows": _over(_packets, _emitted),
        "threshold_config": _thresholds,
        "versioned_settings": _versioned,
        "end_to_end": _end_to_end,
        # the same on streams
        "stream_frames": _stream_frames,
        "stream_syn_rate_windows": _stream_windows(traffic.syn_rate_windows, "syn"),
        "stream_connection_rate_windows": _stream_windows(traffic.connection_rate_windows, "connections"),
        "stream_port_scan_windows": _stream_windows(traffic.port_scan_windows, "ports"),
        "stream_sketched_port_scans": _stream_sketches,
        "stream_capture_rates": _stream_rates,
        "stream_alert_dedup": _stream_dedup,
        "stream_alert_chain": _stream_chain,
        "stream_recent_alerts": _stream_recent,
        "stream_versioned_settings": _stream_versioned,
        "stream_end_to_end": _stream_end_to_end,
    } | (llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {})


def oracle_sql() -> dict[str, str]:
    known = queries()
    written = oracles.oracle_sql() | (llm.oracle_sql() if llm else {})
    if llm and corpus_pipeline.ORACLE_SQL:
        written["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: sql for name, sql in written.items() if name in known}
