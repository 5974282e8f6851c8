"""Small facts that micro-batches leave for later ones, as a table that only grows.

A row belongs to an hour of event time and to the micro-batch that wrote it; both are partition columns. A micro-batch reads the hours it
has alerts in (named in a filter on the partition column) and the batches before it, and adds its own partitions. Repeated after a failure, it reads the
same and replaces its own. Nothing that is there is written again, and hours have nothing to do with each other, so no
source's clock makes another's facts go.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Up to this many hours are named in the filter that prunes the scan; more are joined.
MANY_HOURS = 1000


def hour(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 3_600_000_000).cast("int")


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self._spark, self._folder = spark, folder
        self._schema = T.StructType.fromDDL(schema)
        self._stored = T.StructType([*self._schema, T.StructField("hour", T.IntegerType()), T.StructField("batch", T.LongType())])

    def before(self, batch_id: int, hours: DataFrame) -> DataFrame:
        """Rows of earlier micro-batches in ``hours`` (one column, ``hour``, with distinct values)."""
        try:
            stored = self._spark.read.schema(self._stored).parquet(self._folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], self._schema)
        stored = stored.where(F.col("batch") < batch_id)
        asked = [r[0] for r in hours.limit(MANY_HOURS + 1).collect()]
        if len(asked) <= MANY_HOURS:
            found = stored.where(F.col("hour").isin(asked))
        else:
            found = stored.join(hours, "hour", "left_semi")
        return found.select(*self._schema.names)

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """Leave ``rows``, which have ``hour`` beside the columns of the schema."""
        columns = [rows[f.name].cast(f.dataType).alias(f.name) for f in self._schema]
        made = rows.select(*columns, "hour", F.lit(batch_id).cast("long").alias("batch"))
        # One file per hour: facts of one hour are few.
        writer = made.repartition("hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("hour", "batch").parquet(self._folder)
