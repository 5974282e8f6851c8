"""Port scans over a stream by mergeable sketches.

Every micro-batch leaves its sketches, one per window and source, and its distinct ports in ledgers by hour. The sketches of the windows it
touches are merged with earlier ones; only for sources near the threshold are the ports of earlier micro-batches read and
counted exactly. So what is kept of a source that scans nothing is a small sketch per window, and no set of ports is held in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelark.config import DetectionConfig
from wirelark.operators.sketches import WINDOW, exact_scans, merged_sketches, near_threshold, port_sketches, windowed_ports
from wirelark.session import cut
from wirelark.streaming.ledger import Ledger, hour


class StreamedScans:
    """Windows in which a source reaches the threshold of distinct ports, as soon as it does."""

    def __init__(self, spark: SparkSession, folder: str, config: DetectionConfig = DetectionConfig(), seconds: int = 60) -> None:
        self._config, self._seconds = config, seconds
        self._sketches = Ledger(spark, f"{folder}/sketches", "window_start timestamp, source_ip string, sketch binary")
        self._ports = Ledger(spark, f"{folder}/ports", "window_start timestamp, source_ip string, destination_port int")

    def found(self, packets: DataFrame, batch_id: int) -> DataFrame:
        """``window_start``, ``source_ip`` and ``ports`` of those that this micro-batch concerns, with all ports seen so far."""
        in_hour = hour(F.col("window_start"))
        here = cut(windowed_ports(packets, self._seconds).distinct())
        hours = here.select(in_hour.alias("hour")).distinct()
        own = cut(port_sketches(here))
        before = self._sketches.before(batch_id, hours).join(own.select(*WINDOW), WINDOW, "left_semi")
        near = cut(near_threshold(merged_sketches(own.unionByName(before)), self._config.port_scan_threshold))
        ports = here.unionByName(self._ports.before(batch_id, hours))
        scans = cut(exact_scans(ports, near, self._config.port_scan_threshold))
        self._sketches.add(batch_id, own.withColumn("hour", in_hour))
        self._ports.add(batch_id, here.withColumn("hour", in_hour))
        return scans

    def run(self, source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
        """Start the stream; ``sink`` gets what ``found`` returns for every micro-batch of ``source`` packets."""
        writer = source.writeStream.foreachBatch(lambda batch, batch_id: sink(self.found(batch, batch_id), batch_id))
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
