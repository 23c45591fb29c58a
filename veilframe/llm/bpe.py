"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veilframe.llm.batches import per_text, texts_of

#: Encodings of short pre-tokens that a worker remembers, twice: the newest and those before.
CACHED = 1 << 18
CACHED_CHARS = 64
# Longer texts are cut into pre-tokens one by one.
LONG = 1 << 20

# Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def latin_pattern() -> re.Pattern:
    """The same cuts for texts of Latin-1 characters, in classes that the standard module searches twice as fast."""
    kinds = {name: "" for name in ("L", "N", "s")}
    for char in map(chr, range(256)):
        for name in kinds:
            if regex.match(rf"\p{{{name}}}" if name != "s" else r"\s", char):
                kinds[name] += re.escape(char)
    plain = PATTERN.replace(r"(?!\S)", f"(?![^{kinds['s']}])").replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(kinds.values())}]")
    for name, mark in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s")):
        plain = plain.replace(mark, f"[{kinds[name]}]")
    return re.compile(plain)


def is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the other bytes for the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte) if byte in plain else chr(next(others)) for byte in range(256)]


class Vocabulary(dict):
    """Token ids of pre-tokens, as packed little-endian 32-bit integers; filled as pre-tokens are met."""

    def __init__(self, content: bytes):
        super().__init__()
        self.older: dict[str, bytes] = {}
        data = json.loads(content)
        model, splitter = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or splitter["type"] != "ByteLevel" or data["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE vocabulary")
        if splitter["add_prefix_space"] or not splitter["use_regex"]:
            raise ValueError("this vocabulary cuts texts in another way")
        ids = model["vocab"]
        letters = byte_letters()
        self.first = [ids[letter] for letter in letters]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.base = max(ids.values()) + 1
        self.ranks = {ids[a] * self.base + ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.special = {token["content"]: token["id"] for token in data["added_tokens"]}
        strings = {number: bytes(byte_of[c] for c in string) for string, number in ids.items()}
        strings |= {number: string.encode() for string, number in self.special.items()}
        self.strings = [strings.get(number, b"") for number in range(max(strings) + 1)]
        self.pieces, self.latin = regex.compile(PATTERN), latin_pattern()
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.merged(piece.encode("utf-8", "replace"))
            packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                # What has been used since the last time stays in reach.
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def merged(self, text: bytes) -> list[int]:
        """Ids of one pre-token.

        Symbols form a doubly linked list.  A queue holds the pairs that can be
        merged by rank, then place, both in one number; an entry whose symbols
        no longer have that rank is stale and skipped.
        """
        ranks, base, first = self.ranks, self.base, self.first
        symbols = [first[byte] for byte in text]
        size = len(symbols)
        queue = []
        for at in range(size - 1):
            rank = ranks.get(symbols[at] * base + symbols[at + 1])
            if rank is not None:
                queue.append(rank * size + at)
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while queue:
            rank, at = divmod(heappop(queue), size)
            right = after[at]
            if symbols[at] < 0 or right >= size or ranks.get(symbols[at] * base + symbols[right]) != rank:
                continue
            symbol = symbols[at] = self.made[rank]
            symbols[right] = -1
            after[at] = right = after[right]
            if right < size:
                before[right] = at
                rank = ranks.get(symbol * base + symbols[right])
                if rank is not None:
                    heappush(queue, rank * size + at)
            left = before[at]
            if left >= 0:
                rank = ranks.get(symbols[left] * base + symbol)
                if rank is not None:
                    heappush(queue, rank * size + left)
        return [symbol for symbol in symbols if symbol >= 0]

    def parts(self, text: str) -> Iterable[tuple[str, int | None]]:
        """Stretches of ordinary text, and the special tokens between them with their ids."""
        if self.marks is None or not any(mark in text for mark in self.special):
            return [(text, None)]
        return [(part, self.special.get(part)) for part in self.marks.split(text) if part]

    def pre_tokens(self, text: str) -> Iterable[str]:
        pieces = self.latin if is_latin(text) else self.pieces
        if len(text) <= LONG:
            return pieces.findall(text)
        return (found.group() for found in pieces.finditer(text))

    def encode(self, text: str | None) -> bytes:
        packed = []
        for part, special in self.parts(text or ""):
            if special is None:
                packed += map(self.__getitem__, self.pre_tokens(part))
            else:
                packed.append(special.to_bytes(4, "little"))
        return b"".join(packed)

    def decode(self, packed: bytes | None) -> str:
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


class SharedVocabulary:
    """A vocabulary file that the driver reads and tasks receive once per worker."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            content = file.read()
        self.key = hashlib.sha256(content).hexdigest()
        self.content = spark.sparkContext.broadcast(content)

    def get(self) -> Vocabulary:
        if self.key not in _LOADED:
            _LOADED[self.key] = Vocabulary(self.content.value)
        return _LOADED[self.key]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` of every row of ``docs``: the token ids of its whole text, packed as little-endian unsigned
    32-bit integers.

    Special tokens inside texts count as such; none are added.  A null or
    empty text has no ids.  Rows stay as they are, repeated ones too; a null id
    stays null; other columns are ignored.  Nothing is shuffled.
    """
    shared = SharedVocabulary(docs.sparkSession, path)

    def make():
        vocabulary = shared.get()
        return lambda text: (vocabulary.encode(text),)

    return per_text(texts_of(docs, id_col, text_col), make, "ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (``doc_id``, ``ids`` as ``encoded`` gives them) with their ``text``.

    The strings of the ids are put together and read as UTF-8; what is not
    UTF-8 becomes U+FFFD.  Null ids give an empty text.
    """
    shared = SharedVocabulary(tokens.sparkSession, path)

    def run(batches):
        vocabulary = shared.get()
        for batch in batches:
            texts = [vocabulary.decode(ids.as_py()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    fields = tokens.select("doc_id", "ids")
    return fields.mapInArrow(run, f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` as ``encoded`` gives them and ``text`` as ``decoded`` does, made in one task."""
    shared = SharedVocabulary(docs.sparkSession, path)

    def make():
        vocabulary = shared.get()

        def both(text):
            ids = vocabulary.encode(text)
            return ids, vocabulary.decode(ids)

        return both

    return per_text(texts_of(docs, id_col, text_col), make, "ids binary, text string")
