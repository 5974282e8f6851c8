"""What happens to alerts after detection: limits, duplicates, severity, reports and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelark.config import AlertConfig
from wirelark.operators.ordered import first_rows, running_totals
from wirelark.schema import (
    ALERT_ORDER,
    ALERTS,
    ANOMALOUS_TRAFFIC,
    CRITICAL,
    DETECTOR_ORDER,
    HIGH,
    LOW,
    MEDIUM,
    ML_ANOMALY,
    PORT_SCAN,
    RATE_LIMIT_EXCEEDED,
    SEVERITIES,
    SUSPICIOUS_PAYLOAD,
    SYN_FLOOD,
)

# What makes two alerts duplicates of each other.
SIGNATURE = ["type", "source_ip", "destination_ip", "source_port", "destination_port"]


def alert(
    subjects: DataFrame,
    kind: str,
    severity: int,
    description: Column,
    confidence: Column | None = None,
    extra: list[str] = (),
) -> DataFrame:
    """The alert rows about the packets ``subjects``, and their columns ``extra``."""
    values = {
        "detector_ord": F.lit(DETECTOR_ORDER[kind]),
        "type": F.lit(kind),
        "severity": F.lit(severity),
        "description": description,
        "confidence_score": F.lit(1.0) if confidence is None else confidence,
    }
    columns = [values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ALERTS]
    return subjects.select(*columns, *extra)


def limit_rate(
    alerts: DataFrame, config: AlertConfig = AlertConfig(), used: DataFrame | None = None
) -> DataFrame:
    """The first ``max_alerts_per_second`` alerts of every second of event time.

    A flood puts most alerts into a few seconds, so each second is first limited in many salted parts.
    ``used(second, used)`` says how many alerts of a second were let through before these.
    """
    n = config.max_alerts_per_second
    order = [F.col(c) for c in ALERT_ORDER]
    ranked = first_rows(alerts, {"_second": F.date_trunc("second", "ts")}, order, n)
    if used is not None:
        before = used.withColumnRenamed("second", "_second")
        ranked = ranked.join(before, "_second", "left").where(F.col("_n") <= n - F.coalesce("used", F.lit(0)))
    return ranked.select(*alerts.columns)


def dedup_bucket(config: AlertConfig) -> Column:
    """The aligned stretch of time an alert falls into. As a window, it lets a stream forget old signatures."""
    return F.window("ts", f"{config.dedup_window} seconds")


def dedupe(alerts: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """The first alert of each signature in each aligned stretch of ``dedup_window`` seconds.

    A minimum, unlike a ranking, combines on the map side, so a signature that repeats without end sends
    one row per task. On a stream the first alert to arrive is kept.
    """
    if not config.enable_deduplication:
        return alerts
    bucketed = alerts.withColumn("_bucket", dedup_bucket(config))
    if alerts.isStreaming:
        # One event time column at most: the window keeps the watermark, ts becomes a plain time.
        plain = bucketed.withColumn("ts", F.timestamp_micros(F.unix_micros("ts")))
        return plain.dropDuplicates([*SIGNATURE, "_bucket"]).drop("_bucket")
    rest = [c for c in alerts.columns if c not in SIGNATURE and c not in ALERT_ORDER]
    first = F.min(F.struct(*ALERT_ORDER, *rest)).alias("_first")
    kept = bucketed.groupBy(*SIGNATURE, "_bucket").agg(first)
    return kept.select([F.col(c if c in SIGNATURE else f"_first.{c}").alias(c) for c in alerts.columns])


def severity_of() -> Column:
    """The severity of an alert that came without one (LOW), from its type and confidence."""
    kind = F.col("type")
    by_confidence = F.when(F.col("confidence_score") > 0.8, MEDIUM).otherwise(LOW)
    return (
        F.when(kind.isin(SYN_FLOOD, ML_ANOMALY), HIGH)
        .when(kind.isin(PORT_SCAN, RATE_LIMIT_EXCEEDED), MEDIUM)
        .when(kind.isin(ANOMALOUS_TRAFFIC, SUSPICIOUS_PAYLOAD), by_confidence)
        .otherwise(LOW)
    )


def with_severity(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("severity", F.when(F.col("severity") == LOW, severity_of()).otherwise(F.col("severity")))


def severity_name() -> Column:
    name = F.lit("UNKNOWN")
    for level, text in SEVERITIES.items():
        name = F.when(F.col("severity") == level, text).otherwise(name)
    return name


def with_risk_score(alerts: DataFrame) -> DataFrame:
    """``risk_score``: 25 points per severity level, scaled by the confidence."""
    return alerts.withColumn("risk_score", F.col("severity") * 25.0 * F.col("confidence_score"))


def process(alerts: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """The alert chain: rate limit, then duplicates, then severity."""
    return with_severity(dedupe(limit_rate(alerts, config), config))


def recent_alerts(alerts: DataFrame, count: int = 100, config: AlertConfig = AlertConfig()) -> DataFrame:
    """The newest ``count`` alerts, newest first, out of the last ``recent_limit``."""
    return alerts.orderBy(*[F.col(c).desc() for c in ALERT_ORDER]).limit(min(count, config.recent_limit))


def retain(alerts: DataFrame, config: AlertConfig = AlertConfig(), as_of: Column | None = None) -> DataFrame:
    """Alerts no older than ``alert_retention`` seconds before ``as_of`` (default: the newest alert).

    The default is a scalar subquery; the filter then prunes the scan of a table by its statistics.
    """
    keep = F.make_dt_interval(secs=F.lit(config.alert_retention))
    if as_of is not None:
        return alerts.where(F.col("ts") >= as_of - keep)
    cutoff = alerts.agg((F.max("ts") - keep).alias("cutoff"))
    return alerts.where(F.col("ts") >= cutoff.scalar())


def json_text() -> Column:
    """One alert as a JSON object: fixed field order, UTC seconds, three decimals of confidence."""
    confidence = F.col("confidence_score").cast("decimal(20,3)")
    document = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("type"),
        severity_name().alias("severity"),
        F.col("description"),
        F.col("source_ip"),
        F.col("destination_ip"),
        F.col("source_port"),
        F.col("destination_port"),
        confidence.alias("confidence_score"),
    )
    return F.to_json(document, {"ignoreNullFields": "false"})


def alert_json(alerts: DataFrame) -> DataFrame:
    return alerts.select(*ALERT_ORDER, json_text().alias("json"))


def alert_json_array(alerts: DataFrame, chunk: int = 1000) -> DataFrame:
    """All alerts as JSON arrays, in order: ``second``, ``part``, ``alerts`` and ``json``.

    An array holds at most ``chunk`` alerts of one second of event time; a second with more has several parts, numbered
    from 0. The place of an alert in its second is a running total, which a flood does not put into one task.
    """
    placed = alert_json(alerts).withColumns({"second": F.date_trunc("second", "ts"), "_place": F.lit(1).cast("long")})
    numbered = running_totals(placed, ["second"], [*ALERT_ORDER], ["_place"])
    gathered = numbered.groupBy("second", F.expr(f"(_place - 1) div {chunk}").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("_place", "json"))).alias("_rows")
    )
    text = F.concat(F.lit("["), F.array_join(F.col("_rows.json"), ","), F.lit("]"))
    return gathered.select("second", "part", F.size("_rows").cast("long").alias("alerts"), text.alias("json"))


def tag_outcomes(alerts: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Alerts per second and outcome: processed, dropped by the rate limit, or left out as duplicates; also the first and
    last time of the second, and how many were processed of each severity (``level_n``).

    What the limit drops follows from the number received, so the alerts are ranked once, for the duplicates.
    """
    second = F.date_trunc("second", "ts").alias("second")
    received = alerts.groupBy(second).agg(
        F.count("*").alias("received"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    levels = [F.count_if(F.col("severity") == level).alias(f"level_{level}") for level in SEVERITIES]
    processed = process(alerts, config).groupBy(second).agg(F.count("*").alias("processed"), *levels)
    counts = received.join(processed, "second", "left").na.fill(0, ["processed", *[f"level_{n}" for n in SEVERITIES]])
    kept = F.least(F.col("received"), F.lit(config.max_alerts_per_second).cast("long"))
    return counts.withColumns({"dropped": F.col("received") - kept, "deduplicated": kept - F.col("processed")})


def _totals(alerts: DataFrame, config: AlertConfig) -> DataFrame:
    span = F.expr("(unix_micros(max(last_ts)) - unix_micros(min(first_ts))) div 1000000")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return tag_outcomes(alerts, config).agg(
        total("received").alias("total_alerts_received"),
        total("processed").alias("alerts_processed"),
        total("dropped").alias("alerts_dropped"),
        total("deduplicated").alias("alerts_deduplicated"),
        F.when(span > 0, total("processed") / span).otherwise(F.lit(0.0)).alias("processing_rate_aps"),
        *[total(f"level_{n}").alias(f"level_{n}") for n in SEVERITIES],
    )


def alert_statistics(alerts: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """One row: alerts received, processed, dropped, deduplicated, and processed per second of the whole
    seconds between the first and the last alert (0 if under one)."""
    return _totals(alerts, config).drop(*[f"level_{n}" for n in SEVERITIES])


def _levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEVERITIES.items()), "severity int, severity_name string")


def alert_severity_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per severity, with a row for each of the four levels."""
    counted = alerts.groupBy("severity").agg(F.count("*").alias("_alerts"))
    levels = _levels(alerts.sparkSession)
    return levels.join(counted, "severity", "left").select(
        "severity", "severity_name", F.coalesce("_alerts", F.lit(0).cast("long")).alias("alerts")
    )


def alert_statistics_json(alerts: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """The statistics of the alert chain as one JSON document."""
    names = ["total_alerts_received", "alerts_processed", "alerts_dropped", "alerts_deduplicated"]
    levels = F.concat_ws(",", *[F.col(f"level_{n}").cast("string") for n in (LOW, MEDIUM, HIGH, CRITICAL)])
    text = F.format_string(
        "{" + "".join(f'"{n}":%d,' for n in names) + '"processing_rate_aps":%.2f,"severity_counts":[%s]}',
        *names, "processing_rate_aps", levels,
    )
    return _totals(alerts, config).select(text.alias("json"))
