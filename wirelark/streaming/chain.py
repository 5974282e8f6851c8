"""The alert chain over a stream: limits and duplicates counted across micro-batches.

How many alerts of a second were let through and which signatures were seen is left in ledgers by hour (see ``wirelark.streaming.ledger``).
Within a micro-batch the first alert of a signature is the one with the smallest time, not the one that happens to come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelark.config import AlertConfig
from wirelark.operators.alerts import SIGNATURE, dedup_bucket, dedupe, limit_rate, with_severity
from wirelark.streaming.ledger import Ledger, hour


class AlertChain:
    def __init__(self, spark: SparkSession, folder: str, alerting: AlertConfig | Callable[[], AlertConfig] = AlertConfig()) -> None:
        self._alerting = alerting if callable(alerting) else lambda: alerting
        self._spark, self._folder = spark, folder
        self._used = Ledger(spark, f"{folder}/used", "second timestamp, used long")
        self._seen = Ledger(
            spark, f"{folder}/seen",
            "type string, source_ip string, destination_ip string, source_port int, destination_port int, bucket timestamp",
        )

    def keep(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """``df`` written and read back, for use within one micro-batch. Two places take turns, so that a stream that runs for
        long does not fill the folder."""
        path = f"{self._folder}/{name}/slot={batch_id % 2}"
        df.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def process(self, alerts: DataFrame, batch_id: int) -> DataFrame:
        """The alert chain over one micro-batch: rate limit, duplicates, severity."""
        config = self._alerting()
        alerts = self.keep(alerts, "alerts", batch_id)
        kept = self.keep(self._limited(alerts, config, batch_id), "kept", batch_id)
        second = F.date_trunc("second", "ts").alias("second")
        per_second = kept.groupBy(second).agg(F.count("*").alias("used")).withColumn("hour", hour(F.col("second")))
        self._used.add(batch_id, per_second)
        if not config.enable_deduplication:
            return with_severity(kept)
        return with_severity(self.fresh(kept, config, batch_id))

    def _limited(self, alerts: DataFrame, config: AlertConfig, batch_id: int) -> DataFrame:
        hours = alerts.select(hour(F.col("ts")).alias("hour")).distinct()
        used = self._used.before(batch_id, hours).groupBy("second").agg(F.sum("used").alias("used"))
        return limit_rate(alerts, config, used)

    def fresh(self, alerts: DataFrame, config: AlertConfig, batch_id: int) -> DataFrame:
        """The first alerts of their signatures that no earlier micro-batch has seen in their stretch of time."""
        first = dedupe(alerts, config).withColumn("bucket", dedup_bucket(config).start).withColumn("hour", hour(F.col("bucket")))
        seen = self._seen.before(batch_id, first.select("hour").distinct())
        same = [first[c].eqNullSafe(seen[c]) for c in SIGNATURE]
        fresh = self.keep(first.join(seen, [*same, first["bucket"] == seen["bucket"]], "left_anti"), "fresh", batch_id)
        self._seen.add(batch_id, fresh.select(*SIGNATURE, "bucket", "hour"))
        return fresh.select(*alerts.columns)

    def run(self, alerts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
        """Start the chain over a stream of alerts; ``sink`` gets the processed ones of every micro-batch."""
        writer = alerts.writeStream.foreachBatch(lambda batch, batch_id: sink(self.process(batch, batch_id), batch_id))
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
