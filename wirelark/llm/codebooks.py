"""Vector codes: product quantisation with integer codebooks, assigned by LAESA pivots.

Vectors are cut into ``parts`` equal consecutive parts; each part position has a codebook of up to ``entries`` entries, which
starts as that part of the rows with the smallest ids and is moved to the floor of its parts' mean for ``rounds`` rounds. All
components are integers, so results do not depend on the order of additions.

Which entry is nearest is found with pivots: ``PIVOTS`` of the starting entries of a part position, chosen far from each other.
The distance of every part to every pivot is computed once and stored with the part's block. Each round computes
the distances of the entries to the pivots; by the triangle inequality the distance of a part to an entry is at least
the largest difference of their distances to a pivot. Entries are evaluated exactly, in integers, in order of this bound, until
the bound exceeds the least distance found.

Each round is one scan of the blocks that leaves sums and counts per entry, combined before they are shuffled; the driver sees
the codebooks only, whose size depends on the width of the vectors, not on their number.

Nulls and edge cases: a vector that is null or holds a null or non-finite component takes no part. A null id comes after
all others; rows with one id are ordered by their vectors, so reruns agree. With fewer than ``entries`` rows the
codebooks have that many entries. A shorter vector counts as zero where it ends, and so does what the last part lacks if
the longest width is not divisible by ``parts``. Components of any finite size are exact (Python integers where
64 bits do not do); a distance or a sum of errors beyond the largest long is that long. Extra columns are left out. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wirelark.llm.common import broadcast_if_small, ship
from wirelark.llm.topk import usable
from wirelark.session import store

PARTS, ENTRIES, ROUNDS = 4, 256, 4
PIVOTS = 8
SCALE = 1024
BLOCK = 4096
SALTS = 16
LIMB = 40
# Distances of up to this many bits per component difference fit in 64 bits (16 million components a part).
_SMALL = 1 << 18
_LONG = (1 << 63) - 1
Codebooks = list[np.ndarray]


def whole(vector: list[float], width: int) -> list[int]:
    """floor(``SCALE`` * x) of each component, exactly, and zeros up to ``width``."""
    return [math.floor(SCALE * x) if abs(x) < 1e300 else math.floor(x) * SCALE for x in vector] + [0] * (width - len(vector))


def matrix(rows: list[list[float]], width: int) -> np.ndarray:
    """``rows`` as integers: 64-bit ones if all are small, else Python's."""
    small = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        small[i, : len(row)] = row
    small = np.floor(small * SCALE) if not rows or np.abs(small).max(initial=0) < 1e300 else np.full((1, 1), np.inf)
    if np.abs(small).max(initial=0) < _SMALL:
        return small.astype(np.int64)
    made = np.empty((len(rows), width), dtype=object)
    for i, row in enumerate(rows):
        made[i] = whole(row, width)
    return made


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    if a.dtype != b.dtype:
        a, b = a.astype(object), b.astype(object)
    away = a - b
    return (away * away).sum(axis=-1)


def roots(distances: np.ndarray) -> np.ndarray:
    return np.sqrt(distances.astype(float))


def part(rows: np.ndarray, number: int, parts: int) -> np.ndarray:
    size = -(-rows.shape[1] // parts)
    cut = rows[:, number * size : (number + 1) * size]
    missing = size - cut.shape[1]
    return np.concatenate([cut, np.zeros((len(rows), missing), cut.dtype)], axis=1) if missing else cut


def chosen_pivots(book: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Up to ``pivots`` entries of ``book``, each as far as can be from those before it."""
    picked, nearest = [0], squared(book, book[0])
    while len(picked) < min(pivots, len(book)):
        far = int(np.argmax(nearest))
        picked.append(far)
        nearest = np.minimum(nearest, squared(book, book[far]))
    return book[picked]


def nearest_entries(rows: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of ``book`` for each of ``rows`` (ties: the first), its squared distance, and how many distances were computed.

    ``to_pivots`` are the distances of the rows to the ``pivots``. Each row starts with the entry of its least bound; the others follow in the order
    of their bounds, each for the rows that it may still be nearest to. Where components do not fit in 64 bits there are no bounds, and every entry
    is evaluated.
    """
    small = rows.dtype == book.dtype == pivots.dtype == np.int64
    # Doubles hold these integers, and the sums of their squares, exactly.
    x, c = (rows.astype(float), book.astype(float)) if small else (rows.astype(object), book.astype(object))

    def distances(some: np.ndarray, entries: np.ndarray) -> np.ndarray:
        away = some - entries
        return np.einsum("ij,ij->i", away, away) if small else (away * away).sum(axis=-1)

    bound = np.zeros((len(book), len(rows)), np.float32)
    if small and len(rows):
        of_entries, towards, gap = roots(squared(book[:, None], pivots[None])).astype(np.float32), to_pivots.T.astype(np.float32), np.empty_like(bound)
        for i in range(len(pivots)):
            np.subtract(of_entries[:, i : i + 1], towards[i], out=gap)
            np.maximum(bound, np.abs(gap, out=gap), out=bound)
    best = bound.argmin(axis=0) if len(rows) else np.zeros(0, np.int64)
    least = distances(x, c[best])
    if small and len(rows):
        # Rounding (these numbers have 24 bits) must never lift a bound above the distance it stands for.
        bound -= 1e-5 * (1 + towards.max(axis=0) + of_entries.max())
        np.square(np.maximum(bound, 0, out=bound), out=bound)
    evaluated = len(rows)
    for entry in np.argsort(bound.mean(axis=1), kind="stable").tolist() if len(rows) else ():
        open_ = np.flatnonzero(bound[entry] <= least * (1 + 1e-5)) if small else np.arange(len(rows))
        found = distances(x[open_], c[entry])
        evaluated += len(open_)
        nearer = ((found < least[open_]) | ((found == least[open_]) & (entry < best[open_]))).astype(bool)
        least[open_[nearer]], best[open_[nearer]] = found[nearer], entry
    return best, least.astype(np.int64) if small else least, evaluated


def _limbs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``values`` as sums of ``limb * 2 ** (LIMB * k)`` of 64-bit limbs, so that sums over all rows stay exact."""
    if values.dtype == np.int64:
        yield 0, values
        return
    k = 0
    while not k or any(v for v in values.flat):
        # The sign stays with each limb.
        limb = np.vectorize(lambda v: (-1 if v < 0 else 1) * (abs(v) & ((1 << LIMB) - 1)), otypes=[np.int64])(values)
        yield k, limb
        values = np.vectorize(lambda v: (-1 if v < 0 else 1) * (abs(v) >> LIMB), otypes=[object])(values)
        k += 1


class Quantiser:
    """Codebooks, and the fixed pivots of every part position."""

    def __init__(self, seeds: np.ndarray, parts: int = PARTS) -> None:
        self.parts = parts
        self.books: Codebooks = [part(seeds, i, parts) for i in range(parts)]
        self.pivots = [chosen_pivots(book) for book in self.books]

    def pivot_distances(self, rows: np.ndarray) -> np.ndarray:
        """Rows by parts by pivots."""
        if not len(rows) or any(x.dtype != np.int64 for x in (rows, *self.pivots)):
            return np.zeros((len(rows), self.parts, len(self.pivots[0])))
        return np.stack([roots(squared(part(rows, i, self.parts)[:, None], p[None])) for i, p in enumerate(self.pivots)], axis=1)

    def assigned(self, rows: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part of each row (parts by rows)."""
        made = [
            nearest_entries(part(rows, i, self.parts), to_pivots[:, i], self.books[i], self.pivots[i])[:2] for i in range(self.parts)
        ]
        return np.stack([m[0] for m in made]), np.stack([m[1] for m in made])

    def moved(self, sums: dict[tuple[int, int, int], tuple[int, int]]) -> None:
        """Move entries to the floor of their mean; ``sums`` has (sum, count) by part, entry and position."""
        for i, book in enumerate(self.books):
            new = [[int(x) for x in row] for row in book]
            for e, row in enumerate(new):
                for j in range(len(row)):
                    if (i, e, j) in sums:
                        total, count = sums[i, e, j]
                        row[j] = total // count
            exact = np.empty(book.shape, dtype=object)
            exact[:] = np.array(new, dtype=object).reshape(book.shape)
            fits = all(abs(x) < _SMALL for x in exact.flat)
            self.books[i] = exact.astype(np.int64) if fits else exact

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.flat).encode()).hexdigest()


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    vectors = batch.column(batch.schema.get_field_index("vector"))
    if len(batch) and pc.all(pc.equal(pc.list_value_length(vectors), width)).as_py():
        # Vectors of one width lie side by side.
        scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), width) * SCALE)
        if np.abs(scaled).max(initial=0) < _SMALL:
            return scaled.astype(np.int64)
    return matrix(vectors.to_pylist(), width)


def _stored_pivots(batch: pa.RecordBatch, shape: tuple[int, ...]) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("to_pivots"))
    return np.array([np.frombuffer(x, np.float32) for x in column.to_pylist()], dtype=float).reshape(len(batch), *shape)


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Quantiser | None]:
    """``vec_id``, ``label``, ``codes`` (an entry per part) and ``errors`` (a squared distance per part) of every usable row
    of ``vectors`` (``vec_id``, ``embedding``, ``label``), and the codebooks (None without rows)."""
    ship(vectors.sparkSession)
    kept = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", F.col("embedding").alias("vector"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = kept.agg(F.max(F.size("vector"))).first()[0]
    if not first:
        return kept.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("array<bigint>").alias("errors")), None
    quantiser = Quantiser(matrix([r[0] for r in first], width), parts)
    shape = (parts, len(quantiser.pivots[0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in (batch.slice(a, BLOCK) for a in range(0, len(batch), BLOCK)):
                away = quantiser.pivot_distances(_rows(block, width))
                yield block.append_column("to_pivots", pa.array([x.astype(np.float32).tobytes() for x in away], pa.binary()))

    schema = StructType([*kept.schema.fields]).add("to_pivots", "binary")
    blocks = store(kept.mapInArrow(measure, schema), "quantiser-blocks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for block in (batch.slice(a, BLOCK) for a in range(0, len(batch), BLOCK)):
                rows = _rows(block, width)
                yield block, rows, *quantiser.assigned(rows, _stored_pivots(block, shape))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        counts = np.zeros((parts, entries), np.int64)
        for _, rows, entry, _ in scan(batches):
            for i in range(parts):
                counts[i] += np.bincount(entry[i], minlength=entries)
                for k, limb in _limbs(part(rows, i, parts)):
                    held = sums.setdefault((i, k), np.zeros((entries, limb.shape[1]), np.int64))
                    np.add.at(held, entry[i], limb)
        made = [(i, e, k, int(counts[i, e]), held[e].tolist()) for (i, k), held in sums.items() for e in np.flatnonzero(counts[i])]
        names = ["part", "entry", "limb", "count", "sums"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], t) for c, t in enumerate(types)], names=names)

    for _ in range(rounds):
        partial = blocks.select("vector", "to_pivots").mapInArrow(totals, "part int, entry int, limb int, count long, sums array<bigint>")
        spread = partial.select("part", "entry", "limb", "count", F.posexplode("sums").alias("place", "value"))
        total = F.sum(F.col("value").cast("decimal(38,0)")).alias("total")
        grouped = spread.groupBy("part", "entry", "limb", "place").agg(total, F.sum("count").alias("count"))
        sums: dict[tuple[int, int, int], tuple[int, int]] = {}
        # At most parts * entries * width rows (times the limbs of huge components).
        for r in grouped.collect():
            key = (r["part"], r["entry"], r["place"])
            total, count = sums.get(key, (0, 0))
            # Every row has a limb 0; the others only rows with huge components.
            sums[key] = (total + (int(r["total"]) << (LIMB * r["limb"])), count if r["limb"] else r["count"])
        quantiser.moved(sums)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, entry, away in scan(batches):
            errors = [[min(int(x), _LONG) for x in row] for row in away.T]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(entry.T.tolist(), pa.list_(pa.int32())), pa.array(errors, pa.list_(pa.int64()))],
                names=["vec_id", "label", "codes", "errors"],
            )

    done = StructType([*kept.schema.fields[:2], *StructType.fromDDL("codes array<int>, errors array<bigint>").fields])
    return store(blocks.mapInArrow(finish, done), "quantiser-codes"), quantiser


def _long(total: Column) -> Column:
    return F.least(total, F.lit(_LONG).cast("decimal(38,0)")).cast("long")


def code_digests(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``code`` (two hex digits a part), ``error``, ``label_error`` and ``codebooks_sha256`` of every usable row."""
    found, quantiser = codes(vectors)
    whole_error = F.aggregate("errors", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = found.select("vec_id", "label", code.alias("code"), _long(whole_error).alias("error"))
    totals = store(rows.groupBy("label").agg(_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")), "quantiser-labels")
    small = broadcast_if_small(totals)
    if small is not totals:
        met = rows.join(small.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    else:
        # Many labels: copies of the totals for parts of the rows, so that a hot label is spread.
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        copies = totals.withColumnRenamed("label", "of").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = salted.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(quantiser.digest() if quantiser else "").alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by comparing every part with every entry."""
    width = "(SELECT max(len(v)) FROM kept)"
    steps = [
        f"""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
         [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT row, p, v[p * {width} // {PARTS} + 1 : (p + 1) * {width} // {PARTS}] AS x FROM kept, range({PARTS}) r(p)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS c FROM parts WHERE row <= {ENTRIES})"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"""
near{n} AS MATERIALIZED (
  SELECT row, p, min(struct_pack(d := list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(x, c)]), e := e)) AS m
  FROM parts JOIN book{n} USING (p) GROUP BY row, p)""")
        if n < ROUNDS:
            steps.append(f"""
sums{n} AS (
  SELECT p, m.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS mean
  FROM near{n} JOIN parts USING (row, p), range(1, 1 + {width} // {PARTS}) r(i) GROUP BY p, m.e, i),
book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book{n} b
  LEFT JOIN (SELECT p, e, list(mean ORDER BY i) AS c FROM sums{n} GROUP BY p, e) s ON b.p = s.p AND b.e = s.e)""")
    return f"""
WITH {",".join(steps)},
coded AS (
  SELECT row, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row) CROSS JOIN digest
"""


ORACLE = _oracle()
