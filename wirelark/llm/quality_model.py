"""A byte-level convolutional network in numpy that tells clean documents from junk.

Learned filters of ``WIDTH`` bytes slide over the whole document. Their responses are max-pooled in overlapping chunks, so that a
chunk is known by which patterns it holds anywhere; a chunk that repeats a few words holds few. A small hidden layer turns a
chunk's pooled responses and its length into a logit, and the mean and the least logit of a document's chunks
make one probability. A filter over bytes is a table lookup, and two neighbouring bytes are looked up at once.

Training takes a bounded sample: about ``SAMPLE`` labelled documents of each class that are not held out, and of each
up to ``CROPS`` crops of a chunk from its begin, middle and end, some of them short. It runs on the driver with a fixed seed.

Nulls and edge cases: a null or empty text is scored as a document of no bytes; documents of any length are
scored in blocks of chunks; a null ``doc_id`` is scored but never learned from; without labels of both kinds every score
is 0.5; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wirelark.llm.common import byte_column, small_batches
from wirelark.llm.labelled import held_out, training_sample

CHUNK, STEP, WIDTH, STRIDE = 256, 192, 8, 2
FILTERS, HIDDEN = 32, 24
SAMPLE, CROPS, PIECE = 3000, 3, 512
STEPS, BATCH, RATE, SEED = 2500, 64, 3e-3, 11
ACCEPT = 0.3
# Chunks that are scored at a time.
BLOCK_CHUNKS = 1024


@dataclass
class Network:
    """``filters`` (WIDTH, 256, FILTERS) and their ``offset``; the hidden layer; ``joint``: weights of mean, least and one."""

    filters: np.ndarray
    offset: np.ndarray
    hidden: np.ndarray
    hidden_offset: np.ndarray
    out: np.ndarray
    joint: np.ndarray

    def pairs(self) -> np.ndarray:
        """Responses to each pair of neighbouring bytes, for each even place in a filter."""
        first, second = self.filters[0::2], self.filters[1::2]
        return (first[:, :, None, :] + second[:, None, :, :]).reshape(WIDTH // 2, 1 << 16, FILTERS)

    def logits(self, pooled: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        inputs = np.column_stack([np.tanh(pooled + self.offset), _length_inputs(lengths)])
        return np.maximum(inputs @ self.hidden + self.hidden_offset, 0) @ self.out[:-1] + self.out[-1]


def _length_inputs(lengths: np.ndarray) -> np.ndarray:
    """A chunk's length for the hidden layer: its logarithm, and its share of a whole chunk."""
    lengths = np.minimum(lengths, CHUNK)
    return np.column_stack([np.log1p(lengths) / np.log1p(CHUNK), lengths / CHUNK])


def chunk_bounds(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the overlapping chunks that cover a document of ``length`` bytes. The last one ends with it."""
    begins = np.arange(0, max(1, length - CHUNK + STEP), STEP, dtype=np.int64)
    begins = np.minimum(begins, max(0, length - CHUNK) // STRIDE * STRIDE)
    return begins, np.minimum(begins + CHUNK, max(length, 1))


def pooled_responses(data: bytes, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter in every chunk of ``data``, and the chunks' lengths."""
    begins, ends = chunk_bounds(len(data))
    lengths = np.minimum(ends, len(data)) - begins
    pooled = np.empty((len(begins), FILTERS), dtype=np.float32)
    for a in range(0, len(begins), BLOCK_CHUNKS):
        some, stops = begins[a : a + BLOCK_CHUNKS], ends[a : a + BLOCK_CHUNKS]
        start = int(some[0])
        part = data[start : int(stops[-1])]
        part = part + bytes(2 * WIDTH + len(part) % 2)
        pair = np.frombuffer(part, ">u2")
        places = len(pair) - WIDTH // 2 + 1
        responses = pairs[0][pair[:places]]
        for k in range(1, WIDTH // 2):
            responses += pairs[k][pair[k : k + places]]
        edges = np.empty(2 * len(some), dtype=np.int64)
        edges[0::2] = (some - start) // STRIDE
        # Places whose first byte lies in the chunk.
        edges[1::2] = np.minimum((stops - start + STRIDE - 1) // STRIDE, places - 1)
        edges[1::2] = np.maximum(edges[1::2], edges[0::2] + 1)
        pooled[a : a + BLOCK_CHUNKS] = np.maximum.reduceat(responses, edges, axis=0)[0::2]
    return pooled, lengths


def score(data: bytes, network: Network, pairs: np.ndarray) -> float:
    """Probability that a document is clean."""
    logits = network.logits(*pooled_responses(data, pairs))
    joint = network.joint @ np.array([logits.mean(), logits.min(), 1.0])
    return float(1 / (1 + np.exp(-np.clip(joint, -30, 30))))


def _crops(texts: list[bytes], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Crops of the texts as rows of bytes, their lengths, and which text each is of. Every fourth is a short one."""
    rows, lengths, owners = [], [], []
    for i, text in enumerate(texts):
        for crop in range(CROPS if len(text) > CHUNK else 1):
            size = CHUNK if crop % 4 != 2 else int(rng.integers(8, CHUNK))
            begin = int(rng.integers(0, max(1, len(text) - size + 1)))
            piece = text[begin : begin + size]
            rows.append(np.frombuffer(piece + bytes(CHUNK + WIDTH - len(piece)), np.uint8))
            lengths.append(len(piece))
            owners.append(i)
    return np.array(rows), np.array(lengths), np.array(owners)


def train(texts: list[bytes], labels: list[int]) -> Network | None:
    """A network from some texts, by Adam on the logistic loss of their crops; None without both labels."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(SEED)
    rows, lengths, owners = _crops(texts, rng)
    target = np.array(labels, dtype=np.float64)[owners]
    by_label = [np.flatnonzero(target == value) for value in (0, 1)]
    n_in = FILTERS + 2
    values = {
        "filters": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), "offset": np.full(FILTERS, -0.5),
        "hidden": rng.normal(0, 0.4, (n_in, HIDDEN)), "hidden_offset": np.full(HIDDEN, 0.1), "out": rng.normal(0, 0.4, HIDDEN + 1),
    }
    first, second = ({k: np.zeros_like(v) for k, v in values.items()} for _ in range(2))
    starts = np.arange(0, CHUNK, STRIDE)
    for step in range(1, STEPS + 1):
        some = np.concatenate([rng.choice(which, BATCH // 2) for which in by_label])  # both labels alike
        x, n = rows[some], lengths[some]
        responses = np.zeros((len(some), len(starts), FILTERS))
        for k in range(WIDTH):
            responses += values["filters"][k][x[:, starts + k]]
        responses[starts[None, :] >= np.maximum(n, 1)[:, None]] = -1e9
        best = responses.argmax(axis=1)
        pooled = np.take_along_axis(responses, best[:, None, :], axis=1)[:, 0]
        active = np.tanh(pooled + values["offset"])
        inputs = np.column_stack([active, _length_inputs(n)])
        raw = inputs @ values["hidden"] + values["hidden_offset"]
        hidden = np.maximum(raw, 0)
        logit = hidden @ values["out"][:-1] + values["out"][-1]
        error = (1 / (1 + np.exp(-logit)) - target[some]) / len(some)
        back = error[:, None] * values["out"][:-1] * (raw > 0)
        to_pooled = (back @ values["hidden"].T)[:, :FILTERS] * (1 - active**2)
        gradient = {
            "filters": np.zeros_like(values["filters"]), "offset": to_pooled.sum(axis=0),
            "hidden": inputs.T @ back, "hidden_offset": back.sum(axis=0), "out": np.append(hidden.T @ error, error.sum()),
        }
        at = starts[best]
        for k in range(WIDTH):
            np.add.at(gradient["filters"][k], (np.take_along_axis(x, at + k, axis=1), np.arange(FILTERS)[None, :]), to_pooled)
        for name, value in values.items():
            first[name] += 0.1 * (gradient[name] - first[name])
            second[name] += 0.001 * (gradient[name] ** 2 - second[name])
            value -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    network = Network(
        *(values[k].astype(np.float32) for k in ("filters", "offset", "hidden", "hidden_offset", "out")), joint=np.array([1.0, 0.0, 0.0])
    )
    pairs = network.pairs()
    logits = [network.logits(*pooled_responses(t, pairs)) for t in texts]
    network.joint = _joint(np.array([[x.mean(), x.min(), 1.0] for x in logits]), np.array(labels, dtype=np.float64))
    return network


def _joint(inputs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, held near the mean logit as it is."""
    prior, weights = np.array([1.0, 0.0, 0.0]), np.array([1.0, 0.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        gradient = inputs.T @ (p - target) + (weights - prior)
        weights = weights - np.linalg.solve((inputs * (p * (1 - p))[:, None]).T @ inputs + np.eye(3), gradient)
    return weights


def fitted(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network for the ``quality`` labels of a bounded sample."""
    sample = training_sample(docs, labels, "quality", {0: SAMPLE, 1: SAMPLE})
    # Of a long text three pieces go to the driver, from its begin, its middle and its end.
    size, piece = F.length("text"), F.lit(PIECE)
    middle, last = F.substr("text", (size / 2).cast("int"), piece), F.substr("text", size - PIECE + 1, piece)
    pieces = F.concat(F.substring("text", 1, PIECE), middle, last)
    rows = sample.select("doc_id", F.coalesce(F.when(size > 3 * PIECE, pieces).otherwise(F.col("text")), F.lit("")).alias("text"), "label")
    rows = sorted(rows.collect(), key=lambda r: (r[0], r[1], r[2]))
    return train([r[1].encode() for r in rows], [r[2] for r in rows])


_tables: dict[str, np.ndarray] = {}


def _pairs_once(network: Network) -> np.ndarray:
    key = hashlib.md5(network.filters.tobytes()).hexdigest()
    if key not in _tables:
        _tables.clear()
        _tables[key] = network.pairs()
    return _tables[key]


def scored(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with ``score``, the probability that a document is clean, in place of a column of that name."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs_once(network) if network else None
        for batch in batches:
            texts = byte_column(batch, "text")
            scores = [score(t or b"", network, pairs) if network else 0.5 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(of, StructType([*docs.schema, StructField("score", DoubleType())]))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``."""
    made = scored(docs.select("doc_id", "text"), fitted(docs, labels))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
