"""Running and rolling totals per key that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. Here the rows are range
partitioned by key *and* order, so a hot key is spread over as many partitions as its size calls for, and
only one number per partition has to travel from one to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelark.session import cut

# Rows of one key that are summed in one task by ``rolling_totals``.
BLOCK_ROWS = 1 << 17
# Into how many parts ``first_rows`` splits a key.
SALTS = 64


def _local_totals(keys: list[str], totals: list[str]):
    """A function that replaces ``totals`` by their running sums within each run of equal keys of a sorted
    partition. It holds one Arrow batch at a time and remembers only the last row's key and sums; all other
    columns pass through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_sums = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = {name: batch.column(name) for name in batch.schema.names}
            starts = np.zeros(batch.num_rows, dtype=bool)
            for key in keys:
                values = columns[key]
                starts[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
            starts[0] = last_key != tuple(columns[key][0].as_py() for key in keys)
            run_start = np.maximum.accumulate(np.where(starts, np.arange(batch.num_rows), 0))
            continued = ~np.logical_or.accumulate(starts)
            sums = []
            for i, name in enumerate(totals):
                values = columns[name].to_numpy().astype(np.int64)
                running = np.cumsum(values)
                running = running - np.where(continued, 0, (running - values)[run_start])
                if last_sums is not None:
                    running = running + np.where(continued, last_sums[i], 0)
                columns[name] = pa.array(running)
                sums.append(running[-1])
            last_key, last_sums = tuple(columns[key][-1].as_py() for key in keys), sums
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return run


def running_totals(df: DataFrame, keys: list[str], order: list[str], totals: list[str]) -> DataFrame:
    """``df`` with the whole-number columns ``totals`` replaced by their running sums per key in ``order``.

    ``keys + order`` must identify a row. One range shuffle: a key of any size is cut into ranges, each
    task sums its own range, and what precedes a range comes from a table with at most one row per
    partition, namely for the key that its predecessors began. That bound is why the table is broadcast.
    """
    names = df.columns
    sorted_rows = cut(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ).withColumn("_part", F.spark_partition_id())
    parts = sorted_rows.groupBy("_part", *keys).agg(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        "_part", *keys, *[F.sum(f"_sum_{t}").over(before).alias(f"_carry_{t}") for t in totals]
    ).where(F.col(f"_carry_{totals[0]}").isNotNull())
    local = sorted_rows.mapInArrow(_local_totals(keys, totals), sorted_rows.schema)
    joined = local.join(F.broadcast(carried), ["_part", *keys], "left")
    return joined.select(
        [
            (F.col(c) + F.coalesce(F.col(f"_carry_{c}"), F.lit(0).cast("long"))).alias(c) if c in totals else F.col(c)
            for c in names
        ]
    )


def first_rows(df: DataFrame, keys: dict[str, Column], order: list[Column], rows: int) -> DataFrame:
    """The first ``rows`` rows of each key in ``order``, numbered from 1 in ``_n``. ``keys`` are named ``_...``.

    Each key is first ranked in ``SALTS`` parts, so that a hot key is not ranked in one task; at most
    ``rows`` rows per part are left for the final ranking.
    """
    salted = df.withColumns({**keys, "_salt": F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))})
    in_part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = salted.withColumn("_n", F.row_number().over(in_part)).where(F.col("_n") <= rows)
    in_key = Window.partitionBy(*keys).orderBy(*order)
    return few.withColumn("_n", F.row_number().over(in_key)).where(F.col("_n") <= rows).drop("_salt")


def rolling_totals(
    df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``df`` with ``n``, ``s``, ``q``: count, sum and sum of squares of the whole-number column ``value`` over
    the last ``rows`` rows of the key, the current one included.

    The rows are numbered per key and cut into blocks of ``block_rows``; the last ``rows - 1`` rows of a block
    are copied into the next one, so each block can be worked on alone. A block's sums are running sums
    minus the running sum ``rows`` earlier: linear, whereas a moving window frame adds up all its rows anew
    for every row.
    """
    block_rows = max(block_rows, rows)
    numbered = running_totals(df.withColumn("_rank", F.lit(1).cast("long")), keys, order, ["_rank"])
    block = F.expr(f"(_rank - 1) div {block_rows}")
    near_end = (F.col("_rank") - 1) % block_rows >= block_rows - (rows - 1)
    placed = numbered.withColumn("_home", block).withColumn(
        "_block", F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    in_block = Window.partitionBy(*keys, "_block").orderBy("_rank")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("long")
    summed = placed.withColumns({"_s": F.sum(x).over(so_far), "_q": F.sum(x * x).over(so_far)})
    zero = F.lit(0).cast("long")
    rolled = summed.withColumns(
        {
            "n": F.least(F.col("_rank"), F.lit(rows).cast("long")),
            "s": F.col("_s") - F.coalesce(F.lag("_s", rows).over(in_block), zero),
            "q": F.col("_q") - F.coalesce(F.lag("_q", rows).over(in_block), zero),
        }
    )
    return rolled.where("_home = _block").select(*df.columns, "n", "s", "q")
