"""Counts and rates over packets. Every grouping combines on the map side before it shuffles, so a source
that sends a third of all packets costs one row per task and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.config import DetectionConfig
from wirelark.operators.decode import decode_frames
from wirelark.operators.ordered import rolling_totals
from wirelark.schema import SHOWN_FLAGS, TCP_FLAGS

SYN = TCP_FLAGS["SYN"]


def is_tcp() -> Column:
    return F.col("protocol") == "TCP"


def is_syn() -> Column:
    return is_tcp() & (F.col("tcp_flags").bitwiseAND(SYN) != 0)


def is_port_carrier() -> Column:
    return F.col("protocol").isin("TCP", "UDP")


def protocol_mix(packets: DataFrame) -> DataFrame:
    return packets.groupBy("protocol").agg(
        F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.sum("payload_length").alias("payload_bytes")
    )


def tcp_flag_counts(packets: DataFrame) -> DataFrame:
    """TCP packets per flag, and the position in which the flag is shown."""
    present = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("tcp_flags").bitwiseAND(TCP_FLAGS[name]) != 0,
                    F.struct(F.lit(i).alias("shown"), F.lit(name).alias("flag")),
                )
                for i, name in enumerate(SHOWN_FLAGS + ("URG",), start=1)
            ]
        )
    )
    return (
        packets.where(is_tcp())
        .select(F.explode(present).alias("f"))
        .groupBy("f.shown", "f.flag")
        .agg(F.count("*").alias("packets"))
    )


def packet_statistics(packets: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Packets, bytes, rates and mean size per time window."""
    grouped = packets.groupBy(F.window("ts", f"{window_seconds} seconds").alias("w")).agg(
        F.count("*").alias("total_packets"),
        F.count_if(F.col("protocol") == "TCP").alias("tcp_packets"),
        F.count_if(F.col("protocol") == "UDP").alias("udp_packets"),
        F.count_if(F.col("protocol") == "ICMP").alias("icmp_packets"),
        F.sum("length").alias("total_bytes"),
    )
    count, total = F.col("total_packets").cast("double"), F.col("total_bytes").cast("double")
    return grouped.select(
        F.col("w.start").alias("window_start"),
        "total_packets", "tcp_packets", "udp_packets", "icmp_packets", "total_bytes",
        (count / window_seconds).alias("packets_per_second"),
        (total / window_seconds).alias("bytes_per_second"),
        (total / count).alias("average_packet_size"),
    )


def capture_statistics(frames: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Per interface: frames decoded, dropped packets, capture rate over the observed span, share dropped.

    ``counters(ts, interface_name, dropped, if_dropped)`` holds samples of cumulative counters, of which
    the newest counts; without it nothing was dropped. Both sides are one row per interface when joined.
    """
    captured = decode_frames(frames).groupBy("interface_name").agg(
        F.count("*").alias("packets_captured"),
        ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / F.lit(1e6)).alias("span"),
    )
    if counters is None:
        joined = captured.withColumns({"dropped": F.lit(0).cast("long"), "if_dropped": F.lit(0).cast("long")})
    else:
        newest = counters.groupBy("interface_name").agg(
            F.max_by("dropped", "ts").alias("dropped"), F.max_by("if_dropped", "ts").alias("if_dropped")
        )
        joined = captured.join(newest, "interface_name", "left")
    kept, dropped = F.col("packets_captured"), F.coalesce(F.col("dropped"), F.lit(0).cast("long"))
    return joined.select(
        "interface_name",
        "packets_captured",
        dropped.alias("packets_dropped"),
        F.coalesce(F.col("if_dropped"), F.lit(0).cast("long")).alias("packets_if_dropped"),
        F.when(F.col("span") > 0, kept / F.col("span")).otherwise(F.lit(0.0)).alias("capture_rate_pps"),
        F.when(kept + dropped > 0, dropped / (kept + dropped) * 100).otherwise(F.lit(0.0)).alias("drop_rate_percent"),
    )


def capture_rates(frames: DataFrame, counters: DataFrame, seconds: int = 10, lateness: str = "10 seconds") -> DataFrame:
    """Per interface and aligned window: frames decoded, and the drop counters at the window's end.

    ``counters(ts, interface_name, dropped, if_dropped)`` holds samples of cumulative counters; a window meets the samples from its end
    up to one window later, of which there is one if the device reports once per window. Runs on two streams: the counters come with a watermark
    on ``ts``, the frames without (decoding makes a new column of the time, which gets one of ``lateness``). The windows and the samples of that
    stretch are all that is kept, and a row is written when both have come.
    """
    decoded = decode_frames(frames)
    if frames.isStreaming:  # decoding makes a new column of the time
        decoded = decoded.withWatermark("ts", lateness)
    captured = (
        decoded.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), F.col("interface_name").alias("interface"))
        .agg(F.count("*").alias("packets_captured"))
        .withColumn("until", F.window_time("w"))
    )
    same = (F.col("interface") == F.col("interface_name")) & (F.col("ts") > F.col("until"))
    met = captured.join(counters, same & (F.col("ts") <= F.col("until") + F.expr(f"interval {seconds} seconds")))
    return met.select(
        "interface_name", F.col("w.start").alias("window_start"), F.col("ts").alias("sampled_at"), "packets_captured",
        (F.col("packets_captured") / seconds).alias("capture_rate_pps"), F.col("dropped").alias("packets_dropped"),
        F.col("if_dropped").alias("packets_if_dropped"),
    )


def _per_window(packets: DataFrame, seconds: int, value: Column, name: str) -> DataFrame:
    grouped = packets.where(F.col("source_ip").isNotNull()).groupBy(
        F.window("ts", f"{seconds} seconds").alias("w"), "source_ip"
    )
    return grouped.agg(value.alias(name)).select(F.col("w.start").alias("window_start"), "source_ip", name)


def syn_rate_windows(packets: DataFrame, config: DetectionConfig = DetectionConfig(), seconds: int = 1) -> DataFrame:
    """Sources that reach the SYN threshold within an aligned window. Runs on a stream as well."""
    counted = _per_window(packets.where(is_syn()), seconds, F.count("*"), "syn_packets")
    return counted.where(F.col("syn_packets") >= config.syn_flood_threshold)


def connection_rate_windows(
    packets: DataFrame, config: DetectionConfig = DetectionConfig(), seconds: int = 1
) -> DataFrame:
    """Sources that reach the TCP packet threshold within an aligned window. Runs on a stream as well."""
    counted = _per_window(packets.where(is_tcp()), seconds, F.count("*"), "tcp_packets")
    return counted.where(F.col("tcp_packets") >= config.connection_rate_threshold)


def port_scan_windows(packets: DataFrame, config: DetectionConfig = DetectionConfig(), seconds: int = 60) -> DataFrame:
    """Sources that reach the threshold of distinct destination ports within an aligned window.

    The first grouping has one row per port, at most 65,536 per source and window, so the second one is
    small however many packets went to the ports. On a stream, where two groupings in a row would need two
    watermarks, the ports are kept as a set of that bounded size.
    """
    carrying = packets.where(is_port_carrier())
    if packets.isStreaming:
        counted = _per_window(carrying, seconds, F.size(F.collect_set("destination_port")).cast("long"), "ports")
    else:
        single = _per_window(
            carrying.groupBy("source_ip", F.window("ts", f"{seconds} seconds").start.alias("ts"), "destination_port")
            .agg(F.count("*").alias("packets")),
            seconds, F.count("*"), "ports",
        )
        counted = single
    return counted.where(F.col("ports") >= config.port_scan_threshold)


def packet_rate_series(packets: DataFrame, window_rows: int = 1000) -> DataFrame:
    """Packets per source and second, with mean and standard deviation over the last ``window_rows`` seconds
    that had packets."""
    rates = (
        packets.where(F.col("source_ip").isNotNull())
        .groupBy("source_ip", F.window("ts", "1 second").start.alias("ts"))
        .agg(F.count("*").alias("packets"))
    )
    return with_moments(rolling_totals(rates, ["source_ip"], ["ts"], "packets", window_rows))


def with_moments(totals: DataFrame) -> DataFrame:
    """Mean, population variance and standard deviation from ``n``, ``s`` (sum) and ``q`` (sum of squares)."""
    n, s, q = (F.col(c).cast("double") for c in ("n", "s", "q"))
    mean = s / n
    variance = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), q / n - mean * mean))
    return (
        totals.withColumn("mean", mean)
        .withColumn("variance", variance)
        .withColumn("stddev", F.sqrt("variance"))
        .withColumnRenamed("n", "samples")
        .drop("s", "q")
    )


def judge_rates(packets: DataFrame, thresholds: DataFrame, name: str = "syn_flood_threshold") -> DataFrame:
    """SYN packets per source and second against the value ``name`` of a ``thresholds(name, value)`` table.

    The value is a scalar subquery (the largest, if the name is there twice).
    """
    limit = thresholds.where(F.col("name") == name).agg(F.max("value").alias("threshold"))
    counted = _per_window(packets.where(is_syn()), 1, F.count("*"), "syn_packets")
    return counted.withColumn("threshold", limit.scalar()).withColumn("over", F.col("syn_packets") >= F.col("threshold"))
