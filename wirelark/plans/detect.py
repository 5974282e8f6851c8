"""All detectors over one packet table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.config import DetectionConfig
from wirelark.operators.anchored import detect_port_scan, flood_alerts
from wirelark.operators.rules import suspicious_payload
from wirelark.operators.scoring import Model, ml_anomaly_alerts
from wirelark.operators.sizes import size_zscore_alerts
from wirelark.schema import ANOMALOUS_TRAFFIC, ML_ANOMALY


def detect_all(
    packets: DataFrame, config: DetectionConfig = DetectionConfig(), model: Model | None = None
) -> DataFrame:
    """Alerts of every detector family that is switched on; without a model the ML family finds nothing.

    ``packets`` should be a table: each detector scans the few columns it needs. Settings may change with the packets'
    time (``VersionedConfig``): a packet is judged by those of its time, and a family does not see those of times in which it is off.
    """
    found = []
    if config.rule_based_enabled:
        seen = config.active(packets, "rule_based_enabled")
        found += [flood_alerts(seen, config), detect_port_scan(seen, config), suspicious_payload(seen, config)]
    if config.statistical_enabled:
        found.append(size_zscore_alerts(config.active(packets, "statistical_enabled"), config))
    if config.enable_ml_inference and model is not None:
        found.append(ml_anomaly_alerts(config.active(packets, "enable_ml_inference"), model, config))
    if not found:
        found = [suspicious_payload(packets, config).where(F.lit(False))]
    return reduce(DataFrame.unionByName, found)


def detection_statistics(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: packets, alerts by family, alerts per packet."""
    statistical, learned = F.col("type") == ANOMALOUS_TRAFFIC, F.col("type") == ML_ANOMALY
    seen = packets.agg(F.count("*").alias("total_packets_analyzed"))
    raised = alerts.agg(
        F.count("*").alias("anomalies_detected"),
        F.count_if(~statistical & ~learned).alias("rule_based_alerts"),
        F.count_if(statistical).alias("statistical_alerts"),
        F.count_if(learned).alias("ml_alerts"),
    )
    total, found = F.col("total_packets_analyzed"), F.col("anomalies_detected")
    rate = F.when(total > 0, found / total).otherwise(F.lit(0.0))
    return raised.select(seen.scalar().alias("total_packets_analyzed"), "*").withColumn("detection_rate", rate)
