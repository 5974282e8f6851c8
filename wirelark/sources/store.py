"""Tables of packets and alerts laid out so that scans can leave out what they do not need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from wirelark.config import AlertConfig
from wirelark.schema import ALERTS
from wirelark.session import cut

#: Columns that conditions compare with single values.
LOOKED_UP = ("source_ip", "destination_ip", "source_port", "destination_port")


def write_clustered(
    packets: DataFrame, path: str, by: Sequence[str] = ("source_ip", "ts"), looked_up: Sequence[str] = LOOKED_UP,
    files: int | None = None, block_bytes: int = 32 << 20, mode: str = "append",
) -> None:
    """``packets`` as Parquet in which capture conditions skip row groups.

    Rows are ranged and sorted by ``by`` (a hot source is cut into as many ranges as its size calls for), so the smallest and largest values of
    a row group tell sources and times apart. For the columns ``looked_up`` each row group has a Bloom filter, for values that are spread over
    all ranges.
    """
    ranged = packets.repartitionByRange(files, *by) if files else packets.repartitionByRange(*by)
    writer = ranged.sortWithinPartitions(*by).write.mode(mode).option("parquet.block.size", block_bytes)
    for column in looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


class AlertStore:
    """Processed alerts as a table with a folder per day of event time.

    Readers name the days they want, so old days cost nothing; retention drops whole days by overwriting their partitions and
    rewrites only the day that the cutoff falls into.
    """

    SCHEMA = StructType([*ALERTS.fields, StructField("date", DateType())])

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path

    def write(self, alerts: DataFrame, mode: str = "append") -> None:
        dated = alerts.select(*[f.name for f in ALERTS], F.to_date("ts").alias("date"))
        dated.write.mode(mode).partitionBy("date").parquet(self._path)

    def read(self) -> DataFrame:
        return self._spark.read.schema(self.SCHEMA).parquet(self._path)

    def newest(self) -> Column:
        """The time of the newest alert, as a literal; only the last day that has any is read."""
        last = self.read().agg(F.max("date")).first()[0]
        found = self.read().where(F.col("date") == F.lit(last)).agg(F.max("ts")).first()[0] if last else None
        return F.lit(found).cast("timestamp")

    def retained(self, config: AlertConfig = AlertConfig(), as_of: Column | None = None) -> DataFrame:
        """Alerts no older than ``alert_retention`` seconds before ``as_of`` (default: the newest alert)."""
        since = (self.newest() if as_of is None else as_of) - F.make_dt_interval(secs=F.lit(config.alert_retention))
        found = self.read().where((F.col("date") >= F.to_date(since)) & (F.col("ts") >= since))
        return found.drop("date")

    def drop_old(self, config: AlertConfig = AlertConfig(), as_of: Column | None = None) -> list:
        """Remove what ``retained`` leaves out; returns the days that were emptied. One row per day reaches the driver."""
        since = (self.newest() if as_of is None else as_of) - F.make_dt_interval(secs=F.lit(config.alert_retention))
        days = self.read().where(F.col("date") <= F.to_date(since)).select("date", (F.col("date") < F.to_date(since)).alias("old")).distinct().collect()
        for day, old in days:
            rows = self.read().where(F.col("date") == F.lit(day)).drop("date")
            # Written to the side first: the partition is overwritten while it is read otherwise.
            kept = rows.where("false") if old else cut(rows.where(F.col("ts") >= since))
            kept.write.mode("overwrite").parquet(f"{self._path}/date={day}")
        return sorted(day for day, old in days if old)
