"""Where alerts go: JSON files, and any number of outputs at once."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelark.operators.alerts import json_text

log = logging.getLogger(__name__)

Output = Callable[[DataFrame], None]


def _documents(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.to_date("ts").alias("date"), json_text().alias("value"))


def write_alert_json(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON document per line, in one folder per day, so old days can be read or removed as a whole."""
    _documents(alerts).write.mode(mode).partitionBy("date").text(path)


def stream_alert_json(alerts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The same as a streaming query; files of an unfinished batch are never seen by readers."""
    writer = _documents(alerts).writeStream.partitionBy("date").option("checkpointLocation", checkpoint)
    return writer.format("text").trigger(**(trigger or {"availableNow": True})).start(path)


def fan_out(alerts: DataFrame, outputs: Mapping[str, Output]) -> dict[str, str | None]:
    """Hand the alerts to every output. One that fails is logged and does not keep the others from running.

    Returns the error per output, or None. The alerts are kept (spilling to disk) so that they are computed
    once; if an executor is lost, its part is computed again.
    """
    kept = alerts.persist(StorageLevel.MEMORY_AND_DISK)
    errors: dict[str, str | None] = {}
    try:
        for name, output in outputs.items():
            try:
                output(kept)
                errors[name] = None
            except Exception as error:  # noqa: BLE001 - an output may fail in any way
                log.error("alert output %s failed: %s", name, error)
                errors[name] = str(error)
    finally:
        kept.unpersist()
    return errors


def stream_fan_out(
    alerts: DataFrame, outputs: Mapping[str, Callable[[DataFrame, int], None]], checkpoint: str, **trigger
) -> StreamingQuery:
    """Hand every micro-batch to every output, with the batch number so that outputs can overwrite a repeat."""

    def each(batch: DataFrame, batch_id: int) -> None:
        fan_out(batch, {name: (lambda df, out=out: out(df, batch_id)) for name, out in outputs.items()})

    writer = alerts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
