"""Checksum audits over captured frames, on the bytes as they were on the wire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.functions.bytes import ones_complement, unsigned, word_sum
from wirelark.operators.decode import header_fields
from wirelark.schema import ETHERNET_HEADER


def ip_checksums(frames: DataFrame) -> DataFrame:
    """IPv4 frames with the stored checksum and the one computed over the whole header with options."""
    size = F.col("ip_ihl") * 4
    whole = F.length("frame") >= size + ETHERNET_HEADER
    parsed = header_fields(frames, "ip", ["ip.ihl", "ip.checksum"]).where(whole)
    words = word_sum(F.col("frame"), ETHERNET_HEADER, size) - F.col("ip_checksum")
    return parsed.select(
        "seq", "ts", "source_ip", F.col("ip_checksum").alias("stored"), ones_complement(words).alias("computed")
    )


def tcp_checksums(frames: DataFrame) -> DataFrame:
    """TCP frames with the stored checksum and the one computed over pseudo-header, header and payload.

    The payload is what was captured; a frame cut short by the snap length cannot match, so only frames
    that hold the whole datagram are audited.
    """
    raw, header = F.col("frame"), F.col("ip_ihl") * 4
    size = F.col("ip_total_length") - header
    whole = (F.length("frame") >= F.col("ip_total_length") + ETHERNET_HEADER) & (size >= 20)
    parsed = header_fields(frames, "tcp", ["ip.ihl", "ip.total_length", "tcp.checksum"]).where(whole)
    addresses = unsigned(raw, 26, 4) + unsigned(raw, 30, 4)
    words = word_sum(raw, header + ETHERNET_HEADER, size) + addresses + 6 + size - F.col("tcp_checksum")
    return parsed.select(
        "seq", "ts", "source_ip", F.col("tcp_checksum").alias("stored"), ones_complement(words).alias("computed")
    )


def checksum_audit(checksums: DataFrame) -> DataFrame:
    """Audited and mismatching packets per source."""
    return checksums.groupBy("source_ip").agg(
        F.count("*").alias("audited"),
        F.count_if(F.col("stored") != F.col("computed")).alias("mismatches"),
    )


def ip_checksum_audit(frames: DataFrame) -> DataFrame:
    return checksum_audit(ip_checksums(frames))


def tcp_checksum_audit(frames: DataFrame) -> DataFrame:
    return checksum_audit(tcp_checksums(frames))
