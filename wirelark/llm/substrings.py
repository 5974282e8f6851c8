"""Removal of repeated passages: a count-min prefilter, then exact grouping of what it lets through.

A window is ``size`` consecutive words. The texts, each distinct one once and marked if it has copies, are dealt to
units of bounded size. Each unit counts its windows in a sketch whose width grows with the corpus and which is
kept sparse: the sorted cells that it has hit, cut into slices. Slices of all units are merged (counts add, so they
never fall below the truth) and every unit gets back which of its own cells were hit twice or more. Only windows in
such cells are then grouped by 96 bits of hash, again in slices, and every unit gets back a bit for each one
that it sent. No sketch, index or list of all windows is ever in one place, and texts are shuffled once.

Nulls and edge cases: a null, empty or blank text has no words; a text shorter than a window keeps all words.
Repeated rows are copies: all their windows repeat. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wirelark.llm.common import CACHE_WORDS, byte_column, small_batches

UNIT_BYTES = 8 << 20
CELLS_PER_BYTE = 2
SLICE_BITS = 24
LEAST_SLICES, BYTES_PER_SLICE = 64, 6 << 20
FLUSH_BYTES = 64 << 20
PART_TEXTS = 500

# Odd multipliers of the two rolling hashes and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_hashes = _WordHashes()


class Windows:
    """The windows of some texts: where they start in the run of all words, and two hashes of each."""

    def __init__(self, texts: list[bytes], size: int):
        split = [t.split() for t in texts]
        self.texts = texts
        self.counts = np.array([len(w) for w in split], dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        total = int(self.ends[-1]) if len(split) else 0
        look = _hashes.__getitem__
        words = np.fromiter((look(w) for part in split for w in part), dtype=np.uint64, count=total)
        n = max(0, total - size + 1)
        left = np.repeat(self.ends, self.counts)[:n] - np.arange(n)
        self.starts = np.flatnonzero(left >= size)
        self.owners = np.repeat(np.arange(len(split)), self.counts)[self.starts]
        self.first = self._rolled(words, 0, size, n)[self.starts]
        self.second = self._rolled(_mixed(words), 1, size, n)[self.starts].astype(np.uint32)

    @staticmethod
    def _rolled(words: np.ndarray, which: int, size: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        powers = np.full(len(words), _BASES[which], dtype=np.uint64)
        powers[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(powers))])
        back = np.full(n, _INVERSES[which], dtype=np.uint64)
        back[0] = 1
        return _mixed((sums[size:] - sums[:n]) * np.cumprod(back))


def _cut(slices: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """``(slice, part of each array...)`` from arrays in the order of ``slices``, which is sorted."""
    if not len(slices):
        return []
    edges = np.flatnonzero(np.diff(slices)) + 1
    bounds = zip([0, *edges.tolist()], [*edges.tolist(), len(slices)], strict=True)
    return [(int(slices[a]), *(x[a:b] for x in arrays)) for a, b in bounds]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _columns(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table[n].to_pylist() for n in names), strict=True)


def _packed(cells: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted cells of a slice as the number of cells for each value of their higher bits, and their low 16 bits."""
    high = np.bincount(cells >> 16, minlength=1 << (SLICE_BITS - 16)).astype(np.uint32)
    return high.tobytes(), (cells & 0xFFFF).astype(np.uint16).tobytes()


def _unpacked(high: bytes, low: bytes) -> np.ndarray:
    counts = np.frombuffer(high, np.uint32)
    return (np.repeat(np.arange(len(counts), dtype=np.uint32), counts) << 16) | np.frombuffer(low, np.uint16)


def _two_at_most(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Which elements to keep so that of a kind two stay: a third says no more."""
    keep = np.ones(len(sorted_arrays[0]), bool)
    keep[2:] = np.any([a[2:] != a[:-2] for a in sorted_arrays], axis=0)
    return keep


_PAIR = pa.schema([("unit", pa.int64()), ("slice", pa.int64()), ("one", pa.binary()), ("two", pa.binary())])
_PAIR_SQL = "unit long, slice long, one binary, two binary"
_KEPT = pa.schema([("key", pa.string()), ("n_removed", pa.int64()), ("kept", pa.string())])


def words_key(words: list[bytes]) -> str:
    """128 bits that stand for a sequence of words."""
    return xxhash.xxh3_128_hexdigest(b" ".join(words))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``words_key`` and ``words_sha256`` (of the words joined by one space).

    They take the place of columns of these names.
    """
    small_batches(docs.sparkSession)
    names = ["n_words", "words_key", "words_sha256"]
    docs = docs.drop(*names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(t or b"").split() for t in byte_column(batch, "text")]
            made = [
                pa.array([len(w) for w in split], pa.int64()), pa.array([words_key(w) for w in split], pa.string()),
                pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    fields = [StructField("n_words", LongType()), StructField("words_key", StringType()), StructField("words_sha256", StringType())]
    return docs.mapInArrow(of, StructType([*docs.schema, *fields]))


def dealt_texts(docs: DataFrame, size: int, units: int) -> DataFrame:
    """``unit`` and ``packed``: the distinct texts of at least ``size`` words, as each task has found them.

    A line of a packed text holds the key, whether the task has seen copies, and the words. Every task sends a text
    once, so one with very many copies costs a line for each task.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, held, volume = set(), {}, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            lines: dict[int, list[bytes]] = {}
            for key, (text, copies) in held.items():
                line = b"%s%d %s" % (key.encode(), copies, text)
                lines.setdefault(int(key[:15], 16) % units, []).append(line)
            press = zstandard.ZstdCompressor(level=3)
            for unit, some in lines.items():
                packed = press.compress(b"\n".join(some))
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([packed], pa.binary())], names=["unit", "packed"])

        for batch in batches:
            for text in byte_column(batch, "text"):
                words = (text or b"").split()
                if len(words) < size:
                    continue
                key = words_key(words)
                if key in held:
                    held[key] = (held[key][0], True)
                elif key in sent:
                    held[key] = (b"", True)
                else:
                    held[key] = (b" ".join(words), False)
                    volume += len(text)
            if volume > FLUSH_BYTES:
                yield from flushed()
                sent.update(held)
                held, volume = {}, 0
        yield from flushed()

    return docs.select("text").mapInArrow(of, "unit long, packed binary")


class Unit:
    """The distinct texts of a unit, ordered by key, with their windows."""

    def __init__(self, table: pa.Table, size: int):
        texts: dict[bytes, bytes] = {}
        copies: set[bytes] = set()
        for packed in table["packed"].to_pylist():
            for line in zstandard.ZstdDecompressor().decompress(packed).split(b"\n"):
                key, more, text = line[:32], line[32:33] == b"1", line[34:]
                if more or (text and key in texts):
                    copies.add(key)
                if text:
                    texts[key] = text
        self.keys = sorted(texts)
        self.parts = [Windows([texts[k] for k in self.keys[a : a + PART_TEXTS]], size) for a in range(0, len(self.keys), PART_TEXTS)]
        self.twice = []
        for a, part in zip(range(0, len(self.keys), PART_TEXTS), self.parts, strict=True):
            flags = np.array([k in copies for k in self.keys[a : a + PART_TEXTS]], bool)
            self.twice.append(flags[part.owners])

    def cells(self, width: np.uint64) -> np.ndarray:
        """The sorted cells of the windows, those of texts with copies twice."""
        parts = [w.first % width for w in self.parts]
        cells = np.sort(np.concatenate([*parts, *(c[t] for c, t in zip(parts, self.twice, strict=True))]))
        return cells[_two_at_most(cells)]

    def candidates(self, cells: pa.Table, width: np.uint64, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slice and hashes, in order, of the windows in the given crowded cells; those of texts with copies twice."""
        crowd = np.sort(np.concatenate([
            _unpacked(h, b).astype(np.uint64) | (np.uint64(s) << np.uint64(SLICE_BITS)) for s, h, b in _columns(cells, "slice", "one", "two")
        ]))
        first, second = [], []
        for w, twice in zip(self.parts, self.twice, strict=True):
            at = w.first % width
            near = crowd[np.minimum(np.searchsorted(crowd, at), len(crowd) - 1)] == at
            first += [w.first[near], w.first[near & twice]]
            second += [w.second[near], w.second[near & twice]]
        first, second = np.concatenate(first), np.concatenate(second)
        of = (first >> np.uint64(20)) % np.uint64(slices)
        order = np.lexsort((second, first, of))
        first, second, of = first[order], second[order], of[order]
        keep = _two_at_most(first, second)
        return of[keep], first[keep], second[keep]


def removed_passages(docs: DataFrame, size: int = 35) -> DataFrame:
    """``docs`` with ``n_words``, ``words_key``, ``words_sha256``, ``n_removed`` and ``kept``.

    A word goes if a window that covers it also starts anywhere else, in the same text or another. ``kept`` has the
    words left, joined by one space, and is null where nothing goes. The new columns take the place of any of these names.
    """
    found = repeated(docs, size).withColumnRenamed("key", "words_key")
    known = keyed(docs.drop("n_removed", "kept")).join(found, "words_key", "left")
    return known.withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))


def repeated(docs: DataFrame, size: int) -> DataFrame:
    """``key``, ``n_removed`` and ``kept`` for each distinct text of ``docs`` that loses words."""
    small_batches(docs.sparkSession)
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = dealt_texts(docs, size, max(1, -(-volume // UNIT_BYTES)))
    width = np.uint64(max(1, -(-CELLS_PER_BYTE * volume >> SLICE_BITS)) << SLICE_BITS)
    slices = max(LEAST_SLICES, volume // BYTES_PER_SLICE)

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        cells = Unit(table, size).cells(width)
        low = cells.astype(np.int64) & ((1 << SLICE_BITS) - 1)
        return _table([(key[0].as_py(), s, *_packed(c)) for s, c in _cut(cells >> np.uint64(SLICE_BITS), low)], _PAIR)

    def crowded(table: pa.Table) -> pa.Table:
        parts = [_unpacked(h, b) for h, b in _columns(table, "one", "two")]
        _, back, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        hot, rows, at = counts[back] >= 2, [], 0
        for part, (u, s) in zip(parts, _columns(table, "unit", "slice"), strict=True):
            mine, at = part[hot[at : at + len(part)]], at + len(part)
            if len(mine):
                rows.append((u, s, *_packed(np.unique(mine))))
        return _table(rows, _PAIR)

    def candidates(texts: pa.Table, cells: pa.Table) -> pa.Table:
        if not len(texts) or not len(cells):
            return _table([], _PAIR)
        found = _cut(*Unit(texts, size).candidates(cells, width, slices))
        return _table([(texts["unit"][0].as_py(), s, a.tobytes(), b.tobytes()) for s, a, b in found], _PAIR)

    def repeats(table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)) for a, b in _columns(table, "one", "two")]
        first, second = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((second, first))
        like = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
        again = np.zeros(len(first), bool)
        again[order[1:][like]] = True
        again[order[:-1][like]] = True
        rows, at = [], 0
        for (mine, _), (u, s) in zip(parts, _columns(table, "unit", "slice"), strict=True):
            bits, at = again[at : at + len(mine)], at + len(mine)
            rows.append((u, s, np.packbits(bits).tobytes(), None))
        return _table(rows, _PAIR)

    def remove(texts: pa.Table, replies: pa.Table) -> pa.Table:
        bits = {s: np.frombuffer(one, np.uint8) for s, one, two in _columns(replies, "slice", "one", "two") if two is None}
        cells = replies.filter(replies["two"].is_valid())
        if not len(texts) or not len(cells):
            return _table([], _KEPT)
        unit = Unit(texts, size)
        parts = _cut(*unit.candidates(cells, width, slices))
        again = [np.unpackbits(bits[s], count=len(a)).astype(bool) for s, a, _ in parts]
        first = np.concatenate([a[m] for (_, a, _), m in zip(parts, again, strict=True)])
        second = np.concatenate([b[m] for (_, _, b), m in zip(parts, again, strict=True)])
        if not len(first):
            return _table([], _KEPT)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        rows = []
        for number, w in enumerate(unit.parts):
            hit = w.starts[_pairs_among(w.first, w.second, first, second)]
            marks = np.zeros(int(w.counts.sum()) + size + 1, dtype=np.int64)
            marks[hit] += 1
            marks[hit + size] -= 1
            gone = np.cumsum(marks) > 0
            for i, (end, n) in enumerate(zip(w.ends.tolist(), w.counts.tolist(), strict=True)):
                mine = gone[end - n : end]
                if removed := int(mine.sum()):
                    words = w.texts[i].split()
                    left = b" ".join(words[j] for j in np.flatnonzero(~mine).tolist())
                    rows.append((unit.keys[number * PART_TEXTS + i].decode(), removed, left.decode()))
        return _table(rows, _KEPT)

    hot_cells = texts.groupBy("unit").applyInArrow(sketch, _PAIR_SQL).groupBy("slice").applyInArrow(crowded, _PAIR_SQL)
    met = texts.groupBy("unit").cogroup(hot_cells.groupBy("unit")).applyInArrow(candidates, _PAIR_SQL)
    replies = hot_cells.unionByName(met.groupBy("slice").applyInArrow(repeats, _PAIR_SQL))
    return texts.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(remove, "key string, n_removed long, kept string")


def _pairs_among(one: np.ndarray, two: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which pairs ``one``, ``two`` are among the pairs ``first``, ``second``, which are sorted and not empty."""
    at = np.minimum(np.searchsorted(first, one), len(first) - 1)
    like, found = first[at] == one, np.zeros(len(one), bool)
    while like.any():
        found |= like & (second[at] == two)
        after = np.minimum(at + 1, len(first) - 1)
        like &= (after > at) & (first[after] == one) & ~found
        at = after
    return found


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w1 AS (SELECT row, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM docs),
w2 AS (SELECT *, word || ' ' || lead(word) OVER (PARTITION BY row ORDER BY i) AS two FROM w1),
w4 AS (SELECT *, two || ' ' || lead(two, 2) OVER (PARTITION BY row ORDER BY i) AS four FROM w2),
w8 AS (SELECT *, four || ' ' || lead(four, 4) OVER (PARTITION BY row ORDER BY i) AS eight FROM w4),
w16 AS (SELECT *, eight || ' ' || lead(eight, 8) OVER (PARTITION BY row ORDER BY i) AS sixteen FROM w8),
w35 AS (
  SELECT row, i, word, sixteen || ' ' || lead(sixteen, 16) OVER o || ' ' || lead(two, 32) OVER o || ' ' || lead(word, 34) OVER o AS passage
  FROM w16 WINDOW o AS (PARTITION BY row ORDER BY i)),
counted AS (SELECT row, i, word, passage IS NOT NULL AND count(*) OVER (PARTITION BY passage) > 1 AS again FROM w35),
covered AS (
  SELECT row, i, word, max(CAST(again AS INTEGER)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted),
kept AS (
  SELECT row, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS text FROM covered GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.row = k.row
"""
