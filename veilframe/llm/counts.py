"""Token counts by a two-tier lookup of pre-token lengths, without shuffling pre-tokens."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.batches import per_text, texts_of
from veilframe.llm.bpe import CACHED, CACHED_CHARS, SharedVocabulary, Vocabulary
from veilframe.llm.exact import merged
from veilframe.session import staged

#: A word is frequent when it makes up more than 1/FREQUENT of all: a bound for the broadcast table of its pre-tokens.
FREQUENT = 1 << 16
#: Longer texts are over the limit.
TOKEN_LIMIT = 512


class PackedLengths:
    """A compact table of pre-tokens and their numbers of tokens: their bytes in a row, where each ends, and the numbers."""

    def __init__(self, lengths: dict[str, int]):
        keys = [key.encode() for key in lengths]
        self.key = uuid.uuid4().hex
        self.bytes = b"".join(keys)
        self.ends = np.cumsum([len(key) for key in keys], dtype=np.uint32)
        self.lengths = np.array(list(lengths.values()), np.uint16)

    def table(self) -> dict[str, int]:
        starts = np.r_[0, self.ends[:-1]] if len(self.ends) else self.ends
        keys = (self.bytes[a:b].decode() for a, b in zip(starts.tolist(), self.ends.tolist(), strict=True))
        return dict(zip(keys, self.lengths.tolist(), strict=True))


class Lengths(dict):
    """Tier one, the frequent pre-tokens, is always there.  What it misses is encoded and kept beside it, as the worker's
    cache: the newest and, in ``older``, those before."""

    def __init__(self, frequent: PackedLengths, vocabulary: Vocabulary):
        super().__init__(frequent.table())
        self.frequent, self.older, self.vocabulary = dict(self), {}, vocabulary

    def __missing__(self, piece: str) -> int:
        length = self.older.get(piece)
        if length is None:
            length = len(self.vocabulary.merged(piece.encode("utf-8", "replace")))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= len(self.frequent) + CACHED:
                self.older = dict(self)
                self.clear()
                self.update(self.frequent)
            self[piece] = length
        return length

    def count(self, text: str | None) -> int:
        number = 0
        for part, special in self.vocabulary.parts(text or ""):
            number += 1 if special is not None else sum(map(self.__getitem__, self.vocabulary.pre_tokens(part)))
        return number


_LOADED: dict[str, Lengths] = {}


def frequent_words(share: int):
    """Of a task: the short words that make up more than 1/(4 ``share``) of its words, and the number of all (``word`` null).

    Only words shorter than ``CACHED_CHARS`` are kept, at most 8 ``share`` and those of one text: scripts without spaces make whole sentences one word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, others = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                words = (text.as_py() or "").split()
                short = [word for word in words if len(word) < CACHED_CHARS]
                others += len(words) - len(short)
                counts.update(short)
                if len(counts) > 8 * share:
                    others += sum(counts.values())
                    counts = merged(counts, 4 * share)
                    others -= sum(counts.values())
        words = others + sum(counts.values())
        rows = [(key, n) for key, n in counts.items() if n * 4 * share > words]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *(key for key, _ in rows)], pa.string()), pa.array([words, *(n for _, n in rows)], pa.int64())],
            ["word", "seen"],
        )

    return run


def frequent_lengths(texts: DataFrame, shared: SharedVocabulary, share: int = FREQUENT) -> PackedLengths:
    """Lengths of the pre-tokens of the words that make up more than 1/``share`` of all words in ``texts``.

    Words between white space are counted, which costs far less than cutting
    pre-tokens twice.  Each task sums them up in at most 4 ``share`` counters and
    passes on those that are frequent in it, with the number of all (``word``
    null); the frequent ones are then cut, as they stand behind a space and at a start.
    Which pre-tokens are in the table changes the work only, never a count.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.get()
        for batch in batches:
            cut = {piece for word in batch.column(0).to_pylist() for start in ("", " ") for piece in vocabulary.pre_tokens(start + word)}
            pieces = sorted(cut)
            lengths = [len(vocabulary.merged(piece.encode())) for piece in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(lengths, pa.int32())], ["piece", "length"])

    seen = texts.select("text").mapInArrow(frequent_words(share), "word string, seen long")
    seen = staged(seen.groupBy("word").agg(F.sum("seen").alias("seen")), "words")
    total = seen.where("word is null").select("seen").scalar()
    table = seen.where("word is not null").where(F.col("seen") * share > total).select("word")
    return PackedLengths({row.piece: row.length for row in table.mapInArrow(measured, "piece string, length int").collect()})


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row of ``docs``.

    Whole texts are counted as the vocabulary of ``path`` encodes them, with
    special tokens inside texts as such and none added; ``n_bytes`` is the
    length in UTF-8.  A null or empty text has 0 and 0.  Rows stay as they are,
    repeated ones too; a null id stays null; other columns are ignored.

    The table of frequent lengths holds the pre-tokens of fewer than ``FREQUENT`` short words and is
    broadcast; pre-tokens themselves never move.
    """
    texts = texts_of(docs, id_col, text_col)
    shared = SharedVocabulary(docs.sparkSession, path)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(texts, shared))

    def make():
        frequent = table.value
        if frequent.key not in _LOADED:
            _LOADED.clear()
            _LOADED[frequent.key] = Lengths(frequent, shared.get())
        lengths = _LOADED[frequent.key]
        return lambda text: (len((text or "").encode("utf-8", "replace")), lengths.count(text))

    counted = per_text(texts, make, "n_bytes long, n_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
