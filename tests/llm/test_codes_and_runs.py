"""Vector codes and periodic runs against plain versions, and on rows that go wrong."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import differences, duckdb_over
from wirelark.llm import codebooks, runs


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, label, codes, error) in the order of ids by comparing all parts with all entries, and the codebooks."""
    rows = sorted(((i, v, n) for i, v, n in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max((len(r[1]) for r in rows), default=0)
    size = -(-width // parts)
    cut = [[[math.floor(1024 * Fraction(x)) for x in (*v, *[0.0] * (size * parts - len(v)))][p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in rows]
    books = [[r[p] for r in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for r in cut:
                got.setdefault(nearest(r[p], books[p])[1], []).append(r[p])
            for e, xs in got.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    made = [[nearest(r[p], books[p]) for p in range(parts)] for r in cut]
    return [(r[0], r[2], [e for _, e in m], sum(d for d, _ in m)) for r, m in zip(rows, made, strict=True)], books


VECTORS = [
    (5, [0.5, -0.25, 3.0, 1.0, 0.0, 0.0, 7.5, 2.0], 1), (1, [0.5, -0.25, 3.0, 1.0, 0.0, 0.0, 7.5, 2.0], 1), (2, None, 1), (3, [1.0, None], 2), (4, [float("nan")], 2),
    (6, [float("inf"), 1.0], None), (7, [1e30, -1e30, 1.0, 2.0], None), (8, [], None), (9, [-0.0001, 0.0001], 2), (None, [0.25] * 8, 2), (9, [3.0, 2.0, 1.0], 2),
    (13, [1.7e308, -1.7e308], 1), (14, [5e-324, -5e-324] * 4, 1), (10, [-5.5] * 8, 2), (11, [5.25] * 7, 3), (12, [1e30, -1e30, 1.0, 2.0], None),
]


def check_codes(spark, rows, entries):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, codes string, code string")
    found, quantiser = codebooks.codes(df, entries=entries)
    want, books = plain_codes(rows, entries=entries)
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["label"] or 0, r["codes"], min(sum(r["errors"]), 2**63 - 1)) for r in found.collect())
    assert got == sorted((i is None, i or 0, n or 0, c, min(e, 2**63 - 1)) for i, n, c, e in want)
    assert [[[int(x) for x in e] for e in b] for b in quantiser.books] == books


def test_edge_vectors(spark):
    for entries in (2, 4, 256):
        check_codes(spark, VECTORS, entries)
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert codebooks.code_digests(empty).count() == 0


def test_codes_query(spark):
    con = duckdb_over("/root/testdata/sf0.001")
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert differences(codebooks.code_digests(df), con, codebooks.ORACLE) is None


def test_many_labels_meet_their_sums(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "broadcast_if_small", lambda df: df)
    con = duckdb_over("/root/testdata/sf0.001")
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert differences(codebooks.code_digests(df), con, codebooks.ORACLE) is None


def test_pivots_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (256, 16))
    rows = centres[rng.integers(0, 256, 5000)] + rng.integers(-90, 90, (5000, 16))
    quantiser = codebooks.Quantiser(np.tile(centres, 4))
    to_pivots = quantiser.pivot_distances(np.tile(rows, 4))[:, 0].astype(np.float32).astype(float)
    best, least, evaluated = codebooks.nearest_entries(rows, to_pivots, quantiser.books[0], quantiser.pivots[0])
    every = ((rows[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert evaluated < every.size / 4


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.add((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


words = st.lists(st.integers(0, 2), max_size=40)


@settings(max_examples=300, deadline=None)
@given(words, st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(0, 9), words)
def test_runs(before, unit, times, after):
    w = before + unit * times + after
    assert runs.runs_of(w) == plain_runs(w)


def test_automaton_segments_are_last_ends():
    """Every segment of an access names the last earlier end of its longest suffix."""
    w = [0, 1, 0, 0, 1, 0, 1, 0, 0, 1, 0, 0, 1, 2, 0, 1, 0]
    length, link, prefixes = runs.suffix_automaton(w)
    paths = runs.PreferredPaths(link)
    for end, state in enumerate(prefixes, 1):
        for deepest, before in paths.access(state, end):
            if size := length[deepest]:
                suffix = w[end - size : end]
                assert before == max((e for e in range(size, end) if w[e - size : e] == suffix), default=0)


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in found), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r)))


def test_runs_of_documents(spark, edge):
    rows = [(i, " ".join(f"w{(i * k) % (3 + i % 7)}" for k in range(i))) for i in range(1, 120)]
    rows += [(r["doc_id"], r["text"]) for r in edge.where("length(text) < 50000 or text is null").collect()]
    df = spark.createDataFrame([(*r, *"abcd") for r in rows], "doc_id long, text string, start string, length string, runs string, n_words string")
    assert by_id(tuple(r) for r in runs.run_digests(df).collect()) == by_id(plain_row(*r) for r in rows)
    assert runs.run_digests(df.where("false")).count() == 0


def test_runs_of_a_very_long_text(spark, edge):
    found = runs.periodic_runs(edge.where("doc_id = 7")).first()
    assert [tuple(r) for r in found["runs"]] == [(0, 60_000, 977)] and len(found["collapsed"].split()) == 977


def test_runs_query_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 6000")
    want = by_id(plain_row(*r) for r in docs.collect())
    assert by_id(tuple(r) for r in runs.run_digests(docs).collect()) == want
