"""BPE by a deterministic automaton that is compiled from the merges.

States are tokens: after a token, its state's arcs say which tokens may follow. The automaton starts with the base
symbols, each of which may follow each. Merge k, of ``u`` and ``v``, is applied as a gadget: a new state ``uv`` is a
copy of what state ``v`` is at that time; wherever an arc for ``u`` enters, one for ``uv`` is added beside it; the arc for ``v`` leaves
state ``u`` (and, if u = v, so does the arc for ``uv``). After all merges its paths are exactly the token
sequences that BPE makes, one for each word. Copies are not written out: a gadget keeps whom it copied and when, and an arc
is read back through the gadgets on first use and then kept in the transition table.

A word is encoded from left to right over the table, with a step back where a token leads nowhere. Decoding emits the
labels of the arcs.

Nulls and edge cases: a null or empty text has no tokens and decodes to the empty string; texts of any length are
handled in blocks cut at white space, which never joins tokens; repeated rows give equal rows; an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from wirelark.llm.common import CACHE_WORDS, byte_column, ship, small_batches, word_blocks
from wirelark.llm.vocabulary import byte_symbols, opened, send

KEPT_ARCS = 400_000
_NEVER = 1 << 60


class MergeAutomaton:
    """The tokens and arcs of a BPE model with a word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        size = max(vocab.values(), default=-1) + 1
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[tuple[int, int], int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        self.reached = [True] * size
        for number, (u, v) in enumerate(merges):
            self._gadget(number, vocab[u], vocab[v], vocab[u + v])
        # The tokens that can be reached, without the suffix: those that end a word, and those that do not.
        live = [(t, i) for t, i in vocab.items() if self.reached[i]]
        self.inner = {t: i for t, i in live if not suffix or not t.endswith(suffix)}
        self.ending = {t[: -len(suffix)]: i for t, i in live if t.endswith(suffix)} if suffix else self.inner
        self.longest = max(map(len, [*self.inner, *self.ending]), default=1)

    def _gadget(self, number: int, u: int, v: int, whole: int) -> None:
        if self.born[whole] >= 0:
            raise ValueError("two merges make the same token")
        self.reached[whole] = self.reached[u] and self.reached[v] and self._resolve(u, v, number)
        self.born[whole], self.left[whole], self.right[whole] = number, u, v
        self.cut[(u, v)] = number

    def _resolve(self, state: int, token: int, before: int = _NEVER) -> bool:
        """Whether ``state`` has an arc for ``token`` once the merges before number ``before`` are applied."""
        born, left, right, cut = self.born, self.left, self.right, self.cut
        while True:
            if cut.get((state, token), _NEVER) < before:
                return False
            if born[token] >= born[state]:
                if born[token] < 0:
                    return True
                if left[token] == right[token] == state:
                    return False
                before, token = born[token], left[token]
            else:
                before, state = born[state], right[state]

    def arc(self, state: int, token: int) -> bool:
        pair = (state, token)
        known = self.table.get(pair)
        if known is None:
            known = self._resolve(state, token)
            if len(self.table) < KEPT_ARCS:
                self.table[pair] = known
        return known

    def encode(self, word: str) -> list[int]:
        """The tokens of ``word``, a not empty string of base symbols.

        From each place the longest token that the arcs allow is tried first. A prefix has one path only, so a place that
        leads nowhere is never tried again.
        """
        n, table, longest = len(word), self.table, self.longest
        path, places, dead = [], [], set()
        before, place, limit = -1, 0, longest
        while place < n:
            for end in range(min(n, place + limit), place, -1):
                token = (self.ending if end == n else self.inner).get(word[place:end])
                if token is None or end in dead:
                    continue
                if before >= 0:
                    known = table.get((before, token))
                    if not (self.arc(before, token) if known is None else known):
                        continue
                path.append(token)
                places.append(place)
                before, place, limit = token, end, longest
                break
            else:
                if not path:
                    raise ValueError(f"{word!r} has a symbol that is not in the vocabulary")
                dead.add(place)
                path.pop()
                limit = place - places[-1] - 1
                before, place = path[-1] if path else -1, places.pop()
        return path


# The normal form that the short cuts below stand for, and the parts of a splitting rule.
LOWER_FORM = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_MODEL = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def _refuse(spec: dict) -> None:
    """Raise ValueError for a file that asks for something that ``WordCodec`` does not do."""
    rules = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    split_first = [r["type"] for r in rules] == ["Split", "ByteLevel"] and rules[0]["behavior"] == "Removed" and rules[0]["invert"] and "Regex" in rules[0]["pattern"]
    if not split_first or rules[1]["add_prefix_space"] or rules[1]["use_regex"]:
        raise ValueError("only files that split by a pattern into byte symbols are supported")
    if spec["model"]["type"] != "BPE" or any(spec["model"].get(k, v) != v for k, v in _MODEL.items()) or spec.get("decoder"):
        raise ValueError("only plain merges without a decoder are supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("special tokens must stand for themselves")


class WordCodec:
    """Texts to ids and back, with a tokenizer file's own normal form, splitting rule and special tokens.

    A file with another normal form than ``LOWER_FORM``, with a pattern that takes white space into words, or with white space in a special
    token has its texts encoded whole instead of word by word. What is not supported at all is refused.
    """

    # Printable ASCII without white space, and letters that are their own normal form.
    PLAIN = regex.compile(r"[\x21-\x7EÀ-įı-ž]*")

    def __init__(self, text: str):
        self.tokenizer, spec = Tokenizer.from_str(text), json.loads(text)
        _refuse(spec)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        # The library has the last word on their ids.
        self.specials = {t["content"]: self.tokenizer.token_to_id(t["content"]) for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.marks = sorted({c[0] for c in self.specials})
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        takes_space = any(self.split.fullmatch(s) for s in (" ", " a", "a ", " 1", " .", "a a"))
        self.whole = spec["normalizer"] != LOWER_FORM or takes_space or any(c.split() != [c] for c in self.specials)
        self.labels = {i: t for t, i in (model["vocab"] | self.specials).items()}
        self.symbols = byte_symbols()
        # Kept in decimal: ids of a word of base symbols, ids of a piece of text between blanks, labels of such ids.
        self.words: dict[str, bytes] = _Kept(lambda word: b" ".join(b"%d" % i for i in self.automaton.encode(word)))
        self.codes: dict[bytes, bytes] = _Kept(lambda chunk: b" ".join(self.word_codes(chunk.decode())))
        self.texts: dict[bytes, bytes] = _Kept(lambda ids: self.decode(map(int, ids.split())).encode())

    def pieces(self, part: str) -> list[str]:
        """The words of ``part`` as strings of base symbols."""
        if not self.whole and self.PLAIN.fullmatch(part):
            low = part.lower()
            if low.isalpha():
                found = [low]
            elif low[:-1].isalpha():  # a word and the mark behind it
                found = [low[:-1], low[-1]]
            else:
                found = self.split.findall(low)
            return [w if w.isascii() else "".join(map(self.symbols.__getitem__, w.encode())) for w in found]
        normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def word_codes(self, text: str) -> Iterator[bytes]:
        for part in self.special.split(text) if any(m in text for m in self.marks) else [text]:
            if part in self.specials:
                yield b"%d" % self.specials[part]
            elif part:
                yield from map(self.words.__getitem__, self.pieces(part))

    def encode(self, text: str) -> list[int]:
        return [int(i) for code in self.word_codes(text) for i in code.split()]

    def decode(self, ids: Iterator[int]) -> str:
        """The labels of the ids; the file names no decoder, so they are joined by a space."""
        return " ".join(self.labels[i] for i in ids)

    def code_blocks(self, text: bytes) -> Iterator[list[bytes]]:
        """The ids of ``text`` in decimal, in lists of words'."""
        if self.whole:
            yield list(filter(None, self.word_codes(text.decode())))
            return
        for words in word_blocks(text):
            yield list(filter(None, map(self.codes.__getitem__, words)))

    def id_blocks(self, text: bytes) -> Iterator[bytes]:
        """The ids of ``text`` in decimal, joined by a space, block by block."""
        for codes in self.code_blocks(text):
            if codes:
                yield b" ".join(codes)

    def digests(self, text: bytes) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of what they decode to."""
        count, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
        for codes in self.code_blocks(text):
            if not codes:
                continue
            ids, gap = b" ".join(codes), b" " if count else b""
            ids_digest.update(gap + ids)
            text_digest.update(gap + b" ".join(map(self.texts.__getitem__, codes)))
            count += ids.count(b" ") + 1
        return count, ids_digest.hexdigest(), text_digest.hexdigest()


class _Kept(dict):
    """What has been worked out for a key; as many as ``CACHE_WORDS`` are kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < CACHE_WORDS:
            self[key] = value
        return value


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text, by the tokenizer file ``path``."""
    small_batches(docs.sparkSession)
    sent = send(docs.sparkSession, path)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = opened(sent, WordCodec)
        for batch in batches:
            ids = [[int(i) for b in codec.id_blocks(t or b"") for i in b.split()] for t in byte_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of every row of ids; a null array gives the empty string."""
    ship(ids.sparkSession)
    sent = send(ids.sparkSession, path)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = opened(sent, WordCodec)
        for batch in batches:
            texts = [codec.decode(row or ()) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(of, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row: encoded, then decoded."""
    small_batches(docs.sparkSession)
    sent = send(docs.sparkSession, path)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = opened(sent, WordCodec)
        for batch in batches:
            rows = [codec.digests(t or b"") for t in byte_column(batch, "text")]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    result = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return docs.select("doc_id", "text").mapInArrow(of, StructType([docs.select("doc_id").schema[0], *result]))
