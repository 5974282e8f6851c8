"""Periodic runs of words: a suffix automaton whose link tree is accessed as a link-cut tree.

The suffix links of the automaton of a text form a tree; the path from the state of a prefix to the root holds the
prefix's suffixes, longest first. The tree is kept in preferred paths, one splay tree each, and every path has one
colour: where its strings were last seen to end. Appending word ``i`` accesses the state of prefix ``i``: the path to the root
is recoloured ``i``, segment by segment. A segment of colour ``e`` whose deepest state has length ``l`` says that the last ``l``
words also ended at ``e``, and nowhere since. With ``p = i - e <= l`` the last ``2 p`` words are a square of period
``p``, and its root is primitive: were it a power of a shorter word, the segment would have that word's later colour. So a run of
period ``p`` shows as squares at consecutive ends, and extending a square is counting on while the next word has one.

Every word of every text goes through the automaton: ``O(n log n)`` splay steps for ``n`` words.

Nulls and edge cases: a null, empty or blank text has no words and no runs; a null ``doc_id`` is a row like any other; repeated
rows and ties stay rows of their own; ``repeated_tail`` leaves rows without an id as they are. Extra columns
are left out. An empty table gives an empty result. Memory is proportional to the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wirelark.llm.common import byte_column, small_batches

MIN_WORDS, MIN_REPEATS = 6, 4
Run = tuple[int, int, int]


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Lengths and suffix links of the states (0 is the root), and the state of each prefix of ``words``."""
    length, link, arcs, prefixes, last = [0], [-1], [{}], [], 0
    for word in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        arcs.append({})
        at = last
        while at >= 0 and word not in arcs[at]:
            arcs[at][word] = new
            at = link[at]
        if at >= 0:
            to = arcs[at][word]
            if length[to] != length[at] + 1:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                arcs.append(arcs[to].copy())
                while at >= 0 and arcs[at].get(word) == to:
                    arcs[at][word] = copy
                    at = link[at]
                link[to] = to = copy
            link[new] = to
        prefixes.append(new)
        last = new
    return length, link, prefixes


class PreferredPaths:
    """A rooted tree as preferred paths, each a splay tree ordered by depth with one colour (0: none yet), kept at its root."""

    def __init__(self, parents: list[int]) -> None:
        n = len(parents)
        # Nodes are counted from 1 here. ``up`` is the splay parent or, at a splay root, the node above the path.
        self.up = [0, *(p + 1 for p in parents)]
        self.left, self.right, self.colour = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while True:
            y = up[top]
            if not y or (left[y] != top and right[y] != top):
                break
            top = y
        if top == x:
            return
        self.colour[x] = self.colour[top]
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            # Zig-zig turns the parent first, zig-zag the node twice.
            turns = (y, x) if inner and (left[y] == x) == (left[z] == y) else (x, x) if inner else (x,)
            for a in turns:
                b = up[a]
                c = up[b]
                if left[b] == a:
                    child = left[b] = right[a]
                    right[a] = b
                else:
                    child = right[b] = left[a]
                    left[a] = b
                if child:
                    up[child] = b
                if c:
                    if left[c] == b:
                        left[c] = a
                    elif right[c] == b:
                        right[c] = a
                up[a], up[b] = c, a

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``node`` to the root; the deepest node and the former colour of each segment."""
        right = self.right
        below, x = 0, node + 1
        while x:
            self._splay(x)
            former = self.colour[x]
            yield x - 1, former
            if right[x]:
                self.colour[right[x]] = former
            right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = colour


def runs_of(words: list[int], min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[Run]:
    """``(start, length, period)`` of the runs of ``words`` that are long enough, in order."""
    length, link, prefixes = suffix_automaton(words)
    paths = PreferredPaths(link)
    squares: dict[int, list[int]] = {}  # period: first and last end of the squares in a row
    found: list[Run] = []

    def close(period: int, first: int, last: int) -> None:
        size = last - first + 2 * period
        if size >= max(min_words, min_repeats * period):
            found.append((first - 2 * period, size, period))

    for end, state in enumerate(prefixes, 1):
        for deepest, before in paths.access(state, end):
            period = end - before
            if before and period <= length[deepest]:
                row = squares.get(period)
                if row and row[1] == end - 1:
                    row[1] = end
                else:
                    if row:
                        close(period, *row)
                    squares[period] = [end, end]
    for period, row in squares.items():
        close(period, *row)
    return sorted(found, key=lambda r: (r[0], r[2]))


def document_runs(words: list[bytes]) -> list[Run]:
    """The runs of a text of ``words``, by start, then period."""
    ids: dict[bytes, int] = {}
    return runs_of([ids.setdefault(w, len(ids)) for w in words])


def dropped_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, size, period in runs:
        change[start + period] += 1
        change[start + size] -= 1
    return np.cumsum(change[:-1]) > 0


def repeated_tail(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """``words`` with a tail that repeats, for a tenth of the ids."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(doc_id.encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def periodic_runs(docs: DataFrame, with_tails: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period), ``collapsed`` (the
    words left, joined by one space; null if none goes) and ``collapsed_sha256`` (always).

    ``with_tails`` first repeats the tail of some texts, which gives runs to look for where a corpus has few.
    """
    small_batches(docs.sparkSession)
    run_type = "array<struct<start: bigint, length: bigint, period: bigint>>"
    own = docs.select("doc_id", "text")
    schema = StructType([own.schema[0]]).add("n_words", "long")
    fields = StructType.fromDDL(f"runs {run_type}, collapsed string, collapsed_sha256 string")
    schema = StructType([*schema.fields, *fields.fields])
    arrow_runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts, digests = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_column(batch, "text"), strict=True):
                words = (text or b"").split()
                if with_tails:
                    words = repeated_tail(None if doc_id is None else str(doc_id), words)
                found = document_runs(words)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                if found:
                    gone = dropped_words(len(words), found)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(words)
                texts.append(joined.decode() if found else None)
                digests.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, arrow_runs), pa.array(texts, pa.string()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"],
            )

    return own.mapInArrow(of, schema)


def run_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_runs``, the longest run (ties: smallest start, then period) and digests of runs and collapsed text."""
    found = periodic_runs(docs, with_tails=True)
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as size, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    best = found.withColumn("best", longest)
    size = -F.col("best.size")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), size.alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.size div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256",
    )
