"""Queries of the training-data operators against DuckDB, on the given tables and on documents that go wrong."""

import math

import numpy as np
import pytest

from tests.compare import differences, duckdb_over
from wirelark.llm import chat, entries, mixing, quality_rules, substrings, topk

SQL = entries.oracle_sql()
DOCUMENTS = {
    "op1_mixing": mixing.taken_words,
    "op5_quality_rules": lambda df: quality_rules.judged(df).select(*quality_rules.RESULT),
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    assert differences(entries.queries()[name](spark, sf_dir), duckdb_over(sf_dir), SQL[name]) is None


def over(df):
    """DuckDB over the rows of ``df`` as the table ``documents``."""
    con = duckdb_over("/nowhere")
    rows = df.select("doc_id", "text", "lang", "source").collect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    return con


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
@pytest.mark.parametrize("empty", [False, True])
def test_edge_documents(edge, name, empty):
    docs = edge.where("false") if empty else edge
    assert differences(DOCUMENTS[name](docs), over(docs), SQL[name]) is None


@pytest.mark.parametrize("empty", [False, True])
def test_edge_passages(edge, empty):
    docs = edge.where("false") if empty else edge
    found = substrings.removed_passages(docs)
    digest = "coalesce(sha2(kept, 256), words_sha256) AS kept_sha256"
    got = found.selectExpr("doc_id", "n_words", "n_removed", digest)
    assert differences(got, over(docs), SQL["op7_substring_dedup"]) is None


def test_mix_is_whole_and_even(spark, documents):
    rows = mixing.numbered(mixing.sizes(documents).select("doc_id", "source", "size"))
    sources, mixed = mixing.mix(rows)
    wanted = {r["number"]: (r["need"], r["target"]) for r in sources.collect()}
    by_number = {r["source"]: r["number"] for r in sources.collect()}
    source_of = {r["row"]: by_number[r["source"]] for r in rows.collect()}
    pieces = mixed.orderBy("slot").collect()
    got, slots = {}, {}
    for p in pieces:
        number = source_of[p["row"]]
        got[number] = got.get(number, 0) + p["words"]
        slots.setdefault(p["slot"], []).append(number)
    assert got == {n: need for n, (need, _) in wanted.items() if need}
    assert all(len(set(v)) == 1 for v in slots.values())
    # A stretch of the mix holds the sources near their weights.
    order = [v[0] for _, v in sorted(slots.items())]
    half = order[: len(order) // 2]
    for number, (need, _) in wanted.items():
        assert abs(half.count(number) - order.count(number) / 2) <= 6
    sizes = {r["row"]: r["size"] for r in rows.collect()}
    taken = {}
    for p in pieces:
        taken[p["row"]] = taken.get(p["row"], 0) + p["words"]
    assert all(n <= 2 * sizes[row] for row, n in taken.items())


def test_mixed_documents_hold_the_words_taken(edge):
    from wirelark.llm.common import own_names

    plain = own_names(edge, ["doc_id", "text", "lang", "source", "n_chars"])
    made = mixing.mixed_documents(plain)
    assert made.columns == plain.columns
    rows = made.collect()
    words = sum(len((r["text"] or "").split()) for r in rows if r["doc_id"] != 6)
    want = sum(r["taken"] for r in mixing.taken_words(edge).collect() if r["doc_id"] != 6)
    assert words == want and all(r["n_chars"] == len(r["text"]) for r in rows)


VECTORS = [
    (0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
    (7, [-1.0, 0.001]), (8, [3.0]), (9, [1e6, -1e6, 5.0]), (100, []), (1, [0.5, 0.5]), (None, [9.0, 9.0]),
]


def test_edge_vectors(spark):
    schema = "vec_id long, embedding array<float>, score string, rank string, row string"
    df = spark.createDataFrame([(*v, "x", "y", "z") for v in VECTORS], schema)
    got = {}
    for r in topk.nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    clean = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in VECTORS
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    for query, q in clean:
        if query % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), i) for i, c in clean if i != query)[:5]
            assert got.pop(query) == {n + 1: (-s, i) for n, (s, i) in enumerate(scores)}
    assert not got
    assert topk.nearest(df.where("false")).count() == 0


def test_products_beyond_doubles():
    big = np.array([[2.0**60, 3.0]])
    assert topk._products(big, np.array([[1.0, 5.0]]))[0, 0] == 2**60 + 15
    assert topk._products(big, big)[0, 0] == 2**63 - 1
