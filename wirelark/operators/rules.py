"""Rules that look at one packet alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.config import DetectionConfig
from wirelark.operators.alerts import alert
from wirelark.schema import MEDIUM, SUSPICIOUS_PAYLOAD


def suspicious_payload(packets: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Packets with more payload than the threshold. The comparison reaches a Parquet scan of packets."""
    large = packets.where((F.col("payload_length") > config.payload_size_threshold) & F.col("source_ip").isNotNull())
    large = large.where(F.col("payload_length") > config.limit("payload_size_threshold"))
    text = F.format_string("Large payload detected from %s (%d bytes)", "source_ip", "payload_length")
    return alert(large, SUSPICIOUS_PAYLOAD, MEDIUM, text)
