"""Settings of capture, detection and alerting, with their default values."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Earlier and later than any packet, in microseconds.
EVER = (-(1 << 62), 1 << 62)
#: Settings that trackers and rolling sums are built on; they hold for a whole run.
BUILT_ON = ("moving_average_window", "syn_flood_window", "port_scan_window", "connection_window", "statistics_window")


@dataclass(frozen=True)
class CaptureConfig:
    snap_length: int = 65536
    filter_expression: str = "ip"


@dataclass(frozen=True)
class DetectionConfig:
    """Thresholds and windows (seconds) of the detectors, and which families run."""

    syn_flood_threshold: int = 100
    port_scan_threshold: int = 50
    connection_rate_threshold: int = 1000
    payload_size_threshold: int = 1500

    z_score_threshold: float = 3.0
    z_score_min_samples: int = 10
    moving_average_window: int = 1000
    anomaly_confidence_threshold: float = 0.8

    syn_flood_window: int = 1
    port_scan_window: int = 60
    connection_window: int = 1
    statistics_window: int = 300

    rule_based_enabled: bool = True
    statistical_enabled: bool = True
    enable_ml_inference: bool = False

    def updated(self, **changes) -> DetectionConfig:
        return replace(self, **changes)

    def limit(self, name: str) -> Column:
        """The threshold ``name`` for a row, by its ``ts`` if it changes with time."""
        return F.lit(getattr(self, name))

    def pauses(self, switch: str) -> list[tuple[int, int]]:
        """The stretches of time (microseconds, half-open) in which ``switch`` is off."""
        return [] if getattr(self, switch) else [EVER]

    def active(self, packets: DataFrame, switch: str) -> DataFrame:
        """The ``packets`` of the times in which ``switch`` is on."""
        for start, stop in self.pauses(switch):
            micros = F.unix_micros("ts")
            packets = packets.where(~((micros >= start) & (micros < stop)))
        return packets


@dataclass(frozen=True)
class VersionedConfig(DetectionConfig):
    """Settings that change with the time of the packets.

    ``series`` has, for every setting that changes, its value from each time (microseconds) on, the first one from ever. The
    plain attributes hold the lowest value of a threshold, and whether a family is on at any time: what a prefilter
    may rely on. See ``versioned``.
    """

    series: tuple[tuple[str, tuple[tuple[int, float], ...]], ...] = ()

    def limit(self, name: str) -> Column:
        steps = dict(self.series).get(name, ((EVER[0], getattr(self, name)),))
        value = F.lit(steps[0][1])
        for start, new in steps[1:]:
            value = F.when(F.col("ts") >= F.timestamp_micros(F.lit(start)), F.lit(new)).otherwise(value)
        return value

    def pauses(self, switch: str) -> list[tuple[int, int]]:
        steps = dict(self.series).get(switch, ((EVER[0], getattr(self, switch)),))
        ends = [start for start, _ in steps[1:]] + [EVER[1]]
        return [(start, end) for (start, on), end in zip(steps, ends, strict=True) if not on]


def versioned(base: DetectionConfig, changes: dict[int, dict[str, float]]) -> VersionedConfig:
    """``base``, with the ``changes`` that hold from a time (in microseconds) on, whatever came before."""
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(DetectionConfig)}
    series: dict[str, list[tuple[int, float]]] = {}
    for start in sorted(changes):
        for name, value in sorted(changes[start].items()):
            if name in BUILT_ON:
                raise ValueError(f"{name} holds for a whole run")
            series.setdefault(name, [(EVER[0], getattr(base, name))]).append((start, kinds[name](value)))
    plain = {name: getattr(base, name) for name in kinds}
    for name, steps in series.items():
        plain[name] = (any if kinds[name] is bool else min)(value for _, value in steps)
    return VersionedConfig(**plain, series=tuple((name, tuple(steps)) for name, steps in sorted(series.items())))


@dataclass(frozen=True)
class AlertConfig:
    """Limits of the alert chain (times in seconds)."""

    max_alerts_per_second: int = 1000
    enable_deduplication: bool = True
    dedup_window: int = 300
    alert_retention: int = 86400
    recent_limit: int = 1000


def config_from_table(table: DataFrame, base: DetectionConfig | None = None) -> DetectionConfig:
    """A ``DetectionConfig`` with the numbers of a ``thresholds(name, value)`` table put in.

    The table has one row per setting, so what reaches the driver is bounded by the number of settings;
    names that are no setting are left out before the rows leave the cluster.
    """
    base = base or DetectionConfig()
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    rows = table.where(table["name"].isin(list(kinds))).groupBy("name").agg({"value": "max"}).collect()
    return base.updated(**{row[0]: kinds[row[0]](row[1]) for row in rows})


def versions_from_table(table: DataFrame, base: DetectionConfig | None = None) -> VersionedConfig:
    """The settings of a ``versions(valid_from, name, value)`` table: each value holds for packets from ``valid_from`` on.

    A row per change of a setting reaches the driver; names that are no setting are left out before. If a name has several
    values for one time, the largest counts. In a stream, pass a function that reads the table anew: it is asked for every micro-batch.
    """
    base = base or DetectionConfig()
    known = [f.name for f in fields(DetectionConfig)]
    rows = table.where(table["name"].isin(known)).groupBy(F.unix_micros("valid_from").alias("start"), "name").agg(F.max("value").alias("value")).collect()
    changes: dict[int, dict[str, float]] = {}
    for row in rows:
        changes.setdefault(row["start"], {})[row["name"]] = row["value"]
    return versioned(base, changes)
