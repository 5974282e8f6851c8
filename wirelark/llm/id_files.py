"""Token ids in files of 64-bit words by Simple-8b.

A word holds a four-bit selector and 60 bits of payload: as many ids of equal width as fit the widest of them.
Selectors 0 to 13 stand for 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 and 1 ids. Selector 14 is an escape: its payload is
the place in the block's list of raw 64-bit ids, for ids of more than 60 bits. Ids are cut into blocks that are decoded
by themselves; a block starts with its numbers of ids, words and escapes (three little-endian 32-bit integers), then words
and escapes follow. A segment is some whole documents in order: their blocks one after the other, the byte
offset of each block, and the number of ids of each document. Segments are rows of a Parquet table, one part file for each
range of documents, so any file system that Spark reaches will do.

Nulls and edge cases: a null or empty text has the end id only; rows with equal ``doc_id`` all stay, next to
each other, nulls first; a document of any length is in one segment, in as many blocks as it needs; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from wirelark.llm.common import broadcast_if_small, byte_column, ship, small_batches
from wirelark.llm.vocabulary import byte_symbols, opened, send
from wirelark.session import shared_folder, store

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 14
END_ID = 2
BLOCK_IDS = 1 << 14
SEGMENT_IDS = 1 << 18
FILE_BYTES = 12 << 20
KEPT_PIECES = 900_000
# Up to this character letters are the same in every version of Unicode.
LAST_PLAIN = "ʯ"
_PAYLOAD = (1 << 60) - 1


def pack_block(ids: np.ndarray) -> bytes:
    """A block of unsigned 64-bit ``ids``."""
    n = len(ids)
    escaped = ids > _PAYLOAD
    raw = ids[escaped]
    plain = ids.copy()
    plain[escaped] = 0
    width = np.maximum(np.frexp(plain.astype(np.float64))[1], 1).astype(np.uint8)
    width[escaped] = 61  # wider than any selector takes
    # How many ids a word that starts here holds: the most for which the widest of them fits.
    holds, chosen = np.ones(n, np.uint8), np.full(n, len(COUNTS) - 1, np.uint8)
    widest, span = {1: width}, 1
    for selector in range(len(COUNTS) - 2, -1, -1):
        count = COUNTS[selector]
        if count > n:
            break
        a, b = widest[span][: n - count + 1], widest[span][count - span :][: n - count + 1]
        if count > 2 * span:  # two spans do not reach from end to end
            a = np.maximum(a, widest[span][span : span + n - count + 1])
        top = np.maximum(a, b)
        widest[count], span = top, count
        fits = np.flatnonzero(top <= 60 // count)
        if not len(fits):
            break
        holds[fits], chosen[fits] = count, selector
    starts, at, step = [], 0, holds.tolist()
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, dtype=np.int64)
    kinds = chosen[starts]
    words = np.zeros(len(starts), dtype=np.uint64)
    for selector in np.unique(kinds).tolist():
        count = COUNTS[selector]
        where = np.flatnonzero(kinds == selector)
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(60 // count)
        parts = plain[starts[where][:, None] + np.arange(count)] << shifts
        words[where] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(selector << 60)
    lone = np.flatnonzero(escaped[starts])
    words[lone] = (np.uint64(ESCAPE) << np.uint64(60)) | np.arange(len(lone), dtype=np.uint64)
    return np.array([n, len(words), len(raw)], "<u4").tobytes() + words.astype("<u8").tobytes() + raw.astype("<u8").tobytes()


def unpack_block(data: bytes, offset: int = 0) -> np.ndarray:
    """The ids of the block at ``offset``."""
    n, n_words, n_raw = np.frombuffer(data, "<u4", 3, offset).tolist()
    words = np.frombuffer(data, "<u8", n_words, offset + 12)
    raw = np.frombuffer(data, "<u8", n_raw, offset + 12 + 8 * n_words)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([*COUNTS, 1, 0], dtype=np.int64)[kinds]
    starts = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), dtype=np.uint64)
    payload = words & np.uint64(_PAYLOAD)
    for selector in np.unique(kinds).tolist():
        where = np.flatnonzero(kinds == selector)
        if selector == ESCAPE:
            ids[starts[where]] = raw[payload[where].astype(np.int64)]
            continue
        count = COUNTS[selector]
        width = 60 // count
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
        ids[starts[where][:, None] + np.arange(count)] = (payload[where][:, None] >> shifts) & np.uint64((1 << width) - 1)
    return ids[:n]


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``ids`` in blocks, and the offset of each block."""
    blocks = [pack_block(ids[a : a + BLOCK_IDS]) for a in range(0, len(ids), BLOCK_IDS)]
    return b"".join(blocks), np.cumsum([0, *map(len, blocks[:-1])]).astype("<u8")[: len(blocks)]


def unpack(payload: bytes, offsets: np.ndarray) -> np.ndarray:
    parts = [unpack_block(payload, int(o)) for o in offsets]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class ByteCodec:
    """Ids of texts by a byte-level tokenizer file; the library's model encodes each distinct piece once per worker.

    Texts are cut before a space that follows a character other than white space. No token of this kind of tokenizer
    reaches over such a place, so the ids of the pieces are the ids of the text. A file that normalizes, splits by another rule or
    has special tokens that take in what stands beside them has its texts encoded whole by the library.
    """

    CUT = regex.compile(r"(?<=\S)(?= )")
    # The rule by which these tokenizers split a text.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    PLAIN = regex.compile(r"[\n\x20-\x7Eª-ʯ]*")

    def __init__(self, text: str):
        self.tokenizer, spec = Tokenizer.from_str(text), json.loads(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rule = spec["pre_tokenizer"] or {}
        plain = (rule.get("type"), rule.get("add_prefix_space"), rule.get("use_regex")) == ("ByteLevel", False, True)
        alone = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"])
        model = spec["model"]
        merges = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        self.whole = not (plain and alone and merges and spec["normalizer"] is None)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.chunks: dict[str, bytes] = _Chunks(self)
        self.marks: dict[str, bytes] = {}

    def ids_of(self, chunk: str) -> bytes:
        if not self.PLAIN.fullmatch(chunk) or any(s in chunk for s in self.specials):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.ids_of_word, self.SPLIT.findall(chunk)))

    def mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self.ids_of(mark)
        return self.marks[mark]

    def ids_of_word(self, word: str) -> bytes:
        symbols = "".join(map(self.symbols.__getitem__, word.encode()))
        return array("I", [token.id for token in self.model.tokenize(symbols)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian 32-bit integers."""
        if self.whole:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        try:
            if not first[-1:].isspace():
                return self.ids_of(first) + b"".join(map(self.chunks.__getitem__, rest))
        except _BesideSpace:
            pass
        first, *rest = self.CUT.split(text)
        return self.ids_of(first) + b"".join(self.ids_of(r) for r in rest)


class _BesideSpace(Exception):
    """White space next to a space: only a search tells where to cut."""


class _Chunks(dict):
    """Ids of the pieces that start with a space, by what follows the space."""

    def __init__(self, codec: ByteCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, rest: str) -> bytes:
        if not rest or rest[0].isspace() or rest[-1].isspace():
            raise _BesideSpace
        body = rest[:-1]
        if max(rest) > LAST_PLAIN:
            ids = self.codec.ids_of(" " + rest)
        elif rest.isalpha():
            ids = self.codec.ids_of_word(" " + rest)
        elif body.isalpha() and not rest[-1].isdigit():  # a word and the mark behind it
            ids = self[body] + self.codec.mark(rest[-1])
        else:
            ids = self.codec.ids_of(" " + rest)
        if len(self) < KEPT_PIECES:
            self[rest] = ids
        return ids


def _segments(batches: Iterator[pa.RecordBatch], sent: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    codec, file = opened(sent, ByteCodec), TaskContext.get().partitionId()
    end = np.array([END_ID], "<u4").tobytes()
    before, held, number = 0, [], 0

    def segment() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(x for _, x in held), "<u4").astype(np.uint64)
        payload, offsets = pack(ids)
        values = [file, number, before, [d for d, _ in held], [len(x) // 4 for _, x in held], offsets.tobytes(), payload]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), byte_column(batch, "text"), strict=True):
            held.append((doc, (codec.encode(text.decode()) if text else b"") + end))
            size += len(held[-1][1]) // 4
            if size >= SEGMENT_IDS:
                yield segment()
                before, held, number, size = before + size, [], number + 1, 0
    if held:
        yield segment()


def write_ids(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode every whole ``text``, add the end id, and write the ids to ``path`` in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = send(spark, tokenizer_path)
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = docs.schema["doc_id"].dataType
    result = StructType([
        StructField("file", IntegerType()), StructField("segment", IntegerType()), StructField("first", LongType()),
        StructField("doc_ids", ArrayType(kind)), StructField("counts", ArrayType(LongType())),
        StructField("offsets", BinaryType()), StructField("payload", BinaryType()),
    ])
    arrow = pa.schema([
        ("file", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(_arrow(kind))),
        ("counts", pa.list_(pa.int64())), ("offsets", pa.binary()), ("payload", pa.binary()),
    ])
    # Rows of one doc_id, nulls too, can be dealt to several ranges: their text is part of the order.
    rows = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(max(1, -(-volume // FILE_BYTES)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(lambda b: _segments(b, sent, arrow), result).write.parquet(path)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` of each document, from the files."""
    return _read(spark, path, "ids array<long>", lambda ids: ids.astype(np.int64).tolist(), pa.list_(pa.int64()))


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the files."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, path: str, column: str, value, arrow: pa.DataType) -> DataFrame:
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType
    names = ["doc_id", "file", "before", "n_tokens", column.split(" ")[0]]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                ids = unpack(one["payload"], np.frombuffer(one["offsets"], "<u8"))
                counts = np.array(one["counts"], dtype=np.int64)
                starts = np.cumsum(counts) - counts
                made = [value(ids[a : a + n]) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                        pa.array([one["file"]] * len(counts), pa.int32()), pa.array(starts + one["first"]),
                        pa.array(counts), pa.array(made, arrow),
                    ],
                    names=names,
                )

    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    read = segments.mapInArrow(documents, f"doc_id {kind.simpleString()}, file int, before long, n_tokens long, {column}")
    read = store(read, "id-documents")
    small_batches(spark)
    files = read.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    along = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    begins = files.select(F.col("file"), F.coalesce(F.sum("total").over(along), F.lit(0)).alias("begin"))
    placed = read.join(broadcast_if_small(store(begins, "id-files")), "file")
    return placed.select("doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", names[-1])


def id_file_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the ids of ``docs`` under the shared folder, and read their digests back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/ids/{uuid.uuid4().hex}"
    write_ids(docs, tokenizer_path, path)
    return id_digests(spark, path)
