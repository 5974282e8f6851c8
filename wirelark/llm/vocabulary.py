"""Tokenizer files: read on the driver, sent to the workers, opened there once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import SparkSession

# The default files of the queries; every operator takes the path as a parameter.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# A vocabulary file has a few megabytes; more than this is not one, and is not broadcast.
MOST_BYTES = 64 << 20

_opened: dict[tuple, object] = {}


def send(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """The file ``path`` of the driver, for ``opened`` on the workers."""
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > MOST_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary file")
    return hashlib.md5(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)


def opened(sent: tuple[str, Broadcast], make: Callable[[str], object]) -> object:
    """``make`` of the sent file, once in each worker process."""
    key = (sent[0], make.__qualname__)
    if key not in _opened:
        _opened[key] = make(sent[1].value)
    return _opened[key]


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others, in
    order, for the characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]
