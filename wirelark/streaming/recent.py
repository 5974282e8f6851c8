"""The newest alerts of a stream, in a buffer of bounded size."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wirelark.config import AlertConfig
from wirelark.operators.alerts import recent_alerts


class RecentAlerts:
    """Keeps the newest ``recent_limit`` alerts of all micro-batches.

    The newest of two sets are among the newest of each, so a buffer and a micro-batch merge into the next buffer; each task sends at most
    that many rows. Two places take turns: a micro-batch that is repeated finds the buffer that it found before.
    """

    def __init__(self, spark: SparkSession, folder: str, config: AlertConfig = AlertConfig()) -> None:
        self._spark, self._folder, self._config = spark, folder, config

    def _place(self, batch_id: int) -> str:
        return f"{self._folder}/slot={batch_id % 2}"

    def _buffer(self, batch_id: int, like: DataFrame) -> DataFrame:
        try:
            return self._spark.read.schema(like.schema).parquet(self._place(batch_id))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], like.schema)

    def add(self, alerts: DataFrame, batch_id: int) -> None:
        """Merge a micro-batch into the buffer."""
        both = self._buffer(batch_id - 1, alerts).unionByName(alerts) if batch_id else alerts
        newest = recent_alerts(both, self._config.recent_limit, self._config)
        newest.write.mode("overwrite").parquet(self._place(batch_id))

    def newest(self, batch_id: int, like: DataFrame, count: int = 100) -> DataFrame:
        """The newest ``count`` alerts after micro-batch ``batch_id``, newest first. ``like`` has the columns of the alerts."""
        return recent_alerts(self._buffer(batch_id, like), count, self._config)

    def run(self, alerts: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = alerts.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
