"""Detection and the alert chain over a stream of packets.

Each micro-batch runs the batch operators on its packets together with what its sources' state tells (see
``wirelark.streaming.keyed``), so a stream that arrives in time order gives the same alerts as one batch over the whole. The
state lives in Spark's state store and is read and written only for sources that have sent something. What the
alert chain has to remember, how many alerts of a second were let through and which signatures were seen, is in ledgers.

Packets that arrive after later ones of the same source form older trackers of their own; their sizes are judged
after those that arrived before. What one source's clock says concerns that source only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wirelark.config import AlertConfig, DetectionConfig
from wirelark.operators import anchored, sizes
from wirelark.operators.rules import suspicious_payload
from wirelark.operators.scoring import Model, ml_anomaly_alerts
from wirelark.schema import PACKETS
from wirelark.streaming.chain import AlertChain
from wirelark.streaming.keyed import REPLY, announce, source_states

# What Spark's keyed state needs: a store that holds several state variables, and no micro-batches without data, which
# its processing-time time to live would ask for without end.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class StreamDetector:
    """Turns a stream of packets into processed alerts; tables of the alert chain are in ``folder``."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        detection: DetectionConfig | Callable[[], DetectionConfig] = DetectionConfig(),
        alerting: AlertConfig | Callable[[], AlertConfig] = AlertConfig(),
        model: Model | None = None,
        lateness: int = 86400,
    ) -> None:
        """``detection`` and ``alerting`` may be functions; they are asked anew for every micro-batch, so settings
        can change while the stream runs: from the next micro-batch on (``config_from_table``) or from a time of the packets on
        (``versions_from_table``). A family that is switched off leaves its state as it is.
        A source from which nothing has come for ``lateness`` seconds (of the clock of the machines) is forgotten."""
        self._detection = detection if callable(detection) else lambda: detection
        self._spark, self._model, self._lateness = spark, model, lateness
        self.chain = AlertChain(spark, folder, alerting)

    def detect(self, packets: DataFrame, states: DataFrame, config: DetectionConfig) -> DataFrame:
        """Alerts of one micro-batch. ``packets`` and ``states`` (see ``keyed.REPLY``) are stored tables: they are scanned several times."""
        found = []
        if config.rule_based_enabled:
            seen = config.active(packets, "rule_based_enabled")
            trackers = states.select("source_ip", F.inline("connections"))
            before = states.where(F.col("connection_before").isNotNull()).select("source_ip", "connection_before.*")
            found.append(anchored.flood_alerts_in(anchored.tcp_times(seen), trackers, config, before))
            trackers = states.select("source_ip", F.inline("scans"))
            before = states.select("source_ip", F.col("scan_before").alias("t"), F.explode("ports_before").alias("destination_port"))
            found.append(anchored.scan_alerts_in(anchored.port_times(seen), trackers, config, before))
            found.append(suspicious_payload(seen, config))
        if config.statistical_enabled:
            found.append(sizes.size_zscore_alerts(config.active(packets, "statistical_enabled"), config, sizes.carried_sizes(states)))
        if config.enable_ml_inference and self._model is not None:
            found.append(ml_anomaly_alerts(config.active(packets, "enable_ml_inference"), self._model, config))
        alerts = found[0] if found else suspicious_payload(packets, config).where(F.lit(False))
        for more in found[1:]:
            alerts = alerts.unionByName(more)
        return alerts

    def process(self, alerts: DataFrame, batch_id: int) -> DataFrame:
        """The alert chain over the alerts of one micro-batch."""
        return self.chain.process(alerts, batch_id)

    def run(
        self,
        source: DataFrame,
        sink: Callable[[DataFrame, int], None],
        checkpoint: str,
        to_packets: Callable[[DataFrame], DataFrame] = lambda df: df,
        **trigger,
    ) -> StreamingQuery:
        """Start the stream: ``to_packets`` turns ``source`` (say, frames) into packets row by row, ``sink`` gets the
        processed alerts and the batch number of every micro-batch."""
        columns = [f.name for f in PACKETS]
        packets = to_packets(source).select(*columns)
        states = source_states(packets, self._lateness)
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in PACKETS]
        reply = F.struct(*states.columns).alias("state")
        both = packets.withColumn("state", F.lit(None).cast(StructType.fromDDL(REPLY))).unionByName(states.select(*nothing, reply))

        def each(batch: DataFrame, batch_id: int) -> None:
            config = self._detection()
            announce(self._spark, config)
            rows = self.chain.keep(batch, "rows", batch_id)
            packets, states = rows.where("state is null").drop("state"), rows.where("state is not null").select("state.*")
            sink(self.process(self.detect(packets, states, config), batch_id), batch_id)

        writer = both.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        former = {name: self._spark.conf.get(name, None) for name in STREAM_SETTINGS}
        try:
            for name, value in STREAM_SETTINGS.items():
                self._spark.conf.set(name, value)
            # The query keeps the settings that it was started with.
            return writer.trigger(**(trigger or {"availableNow": True})).start()
        finally:
            for name, value in former.items():
                if value is None:
                    self._spark.conf.unset(name)
                else:
                    self._spark.conf.set(name, value)

