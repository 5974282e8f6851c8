"""Exact top-k search by inner product: tiled matrix products, selection per tile, tree merging.

Vectors are packed into blocks, queries and candidates apart. The grid of query blocks and candidate blocks is
cut into cells of ``side`` by ``side`` blocks; a block is sent to the cells of its row or column, and within a cell each
pair of blocks is one matrix product from which the best ``k`` per query go on. Lists are merged by groups of
tiles, then over the groups. A cell holds a bounded number of vectors however large the tables are.

Nulls and edge cases: vectors that are null or hold a null or non-finite component take no part; a shorter vector
counts as zero where it ends; a ``vec_id`` in several rows stands for all of them, and a query is never its own
candidate; ties go to the smaller ``vec_id``; a null ``vec_id`` takes no part. Scores are exact: doubles where they
hold all integers that can occur, Python integers beyond, limited to the range of a long. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelark.llm.common import ship
from wirelark.session import store

BLOCK = 1024
SIDE = 4
MERGE_GROUP = 64
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def scaled(vector: Column) -> Column:
    """floor(256 * x) of each component, as doubles (integers in value)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def packed(vectors: DataFrame, kind: str) -> DataFrame:
    """``vectors`` (``vec_id``, ``vector`` of doubles) in blocks: ``ids``, ``data`` (doubles, row by row) and ``width``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, BLOCK) for a in range(0, len(batch), BLOCK)):
                rows = part.column(1).to_pylist()
                width = max(map(len, rows))
                data = np.zeros((len(rows), width))
                for i, row in enumerate(rows):
                    data[i, : len(row)] = row
                ids = part.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()), pa.array([width], pa.int32())],
                    names=["ids", "data", "width"],
                )

    ship(vectors.sparkSession)
    blocks = vectors.mapInArrow(pack, "ids binary, data binary, width int")
    return store(blocks.withColumn("block", F.monotonically_increasing_id()), f"top-{kind}")


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["data"], np.float64).reshape(len(ids), row["width"])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    if not width:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if np.abs(a).max() * np.abs(b).max() * width < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[max(-_LONG - 1, min(_LONG, sum(x * y for x, y in zip(p, q, strict=True)))) for q in whole[1]] for p in whole[0]], dtype=np.int64)


def _best(queries: dict, candidates: dict, k: int) -> list[tuple[np.ndarray, ...]]:
    """The best ``k`` candidates of a block for each query of a block: query ids, candidate ids, scores."""
    (q_ids, q), (c_ids, c) = _matrix(queries), _matrix(candidates)
    by_id = np.argsort(c_ids, kind="stable")
    c_ids, scores = c_ids[by_id], _products(q, c[by_id])
    out = []
    for i, query in enumerate(q_ids.tolist()):
        row = scores[i]
        open_ = np.flatnonzero(c_ids != query)
        if len(open_) > 4 * k:
            # The k-th largest score; all that reach it stay, so that ties are settled by id.
            least = np.partition(row[open_], len(open_) - k)[len(open_) - k]
            open_ = open_[row[open_] >= least]
        top = open_[np.argsort(-row[open_], kind="stable")[:k]]
        out.append((np.full(len(top), query), c_ids[top], row[top]))
    return out


_SCORED = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("tile", pa.int64())])


def _merged(scored: DataFrame, k: int, *keys: Column) -> DataFrame:
    order = Window.partitionBy("query_id", *keys).orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` best candidates of each query.

    Both tables have ``vec_id`` and ``vector`` (an array of doubles that hold integers).
    """
    asked, offered = packed(queries, "queries"), packed(candidates, "candidates")
    cells = {n: -(-max(1, df.count()) // SIDE) for n, df in (("row", asked), ("column", offered))}
    group = {n: F.pmod(F.xxhash64("block"), F.lit(m)) for n, m in cells.items()}
    every = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))) for n, m in cells.items()}
    left = asked.select(group["row"].alias("row"), "*").withColumn("column", every["column"])
    right = offered.select(group["column"].alias("column"), "*").withColumn("row", every["row"])

    def tile(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        number = key[0].as_py() * cells["column"] + key[1].as_py()
        parts = [x for q in queries.to_pylist() for c in candidates.to_pylist() for x in _best(q, c, k)]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.table([*map(pa.array, columns), pa.array(np.full(len(columns[0]), number))], schema=_SCORED)

    scored = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(
        tile, "query_id long, vec_id long, score long, tile long"
    )
    tiles = cells["row"] * cells["column"]
    while tiles > MERGE_GROUP:
        scored = _merged(scored, k, F.col("tile")).withColumn("tile", F.expr(f"tile div {MERGE_GROUP}"))
        tiles = -(-tiles // MERGE_GROUP)
    return _merged(scored, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` best of all ``vectors`` (``vec_id``, ``embedding``) for each whose id is divisible by ``every``."""
    usable_rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = usable_rows.select(F.col("vec_id").cast("long"), scaled(F.col("embedding")).alias("vector"))
    return top_k(rows.where(F.col("vec_id") % every == 0), rows, k)


ORACLE = """
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (
  SELECT row, vec_id, unnest(range(len(embedding))) AS i, unnest([CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS x FROM rows),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY q.row, q.vec_id, c.row, c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
