"""Packing documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veilframe.llm.batches import texts_of
from veilframe.llm.bpe import PATTERN, SharedVocabulary, Vocabulary

WINDOW = 2048
#: The id that ends each document.
END = 1
#: So many windows may be open at once; one more, and all are closed by cutting their documents to fit.
MOST_OPEN = 4096
#: Pieces go back when they hold so many ids.
RETURNED_IDS = 1 << 20

Piece = tuple[int, int, np.ndarray]  # number of the row in the task, ids before it, ids


def power_of_two(size: int) -> bool:
    return size & (size - 1) == 0


class Levels:
    """Open windows by fill level.

    The level array counts the windows at each level that would have to be
    padded.  A document goes where the sum of the squares of these counts
    comes out least, be it a new window or one with room; of equal choices the
    fullest.  Full windows and those filled to a power of two need no padding and do not count, but the latter
    stay open.
    """

    def __init__(self, window: int, most_open: int = MOST_OPEN):
        self.window, self.most_open, self.number = window, most_open, 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.padded = np.array([not power_of_two(level) for level in range(window + 1)], np.int64)
        self.padded[window] = self.padded[0] = 0
        # How much the sum falls when a window leaves a level (never, if there is none), and grows when one arrives.
        self.leaving = np.full(window + 1, -np.inf)
        self.leaving[0] = 0
        self.arriving = self.padded.astype(np.float64)

    def _changed(self, level: int) -> None:
        count = len(self.open[level])
        self.leaving[level] = self.padded[level] * (2 * count - 1) if count else -np.inf
        self.arriving[level] = self.padded[level] * (2 * count + 1)

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Put a piece shorter than a window where it belongs; gives the windows that are closed by that."""
        size = len(piece[2])
        cost = self.arriving[size:] - self.leaving[: self.window + 1 - size]
        level = self.window - size - int(np.argmin(cost[::-1]))
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self._changed(level)
            self.number -= 1
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
            return
        self.open[level + size].append(pieces)
        self._changed(level + size)
        self.number += 1
        if self.number > self.most_open:
            yield from self.close()

    def close(self) -> Iterator[list[Piece]]:
        """Close all windows.  Their pieces are put in a row, the fullest windows first, and cut at each window's end;
        the last, unfinished window is cut into sequences of powers of two."""
        row: list[Piece] = []
        filled = 0
        for level in reversed(range(1, self.window)):
            for pieces in self.open[level]:
                for number, start, ids in pieces:
                    while filled + len(ids) >= self.window:
                        room = self.window - filled
                        yield [*row, (number, start, ids[:room])]
                        row, filled, start, ids = [], 0, start + room, ids[room:]
                    if len(ids):
                        row.append((number, start, ids))
                        filled += len(ids)
            if self.open[level]:
                self.open[level] = []
                self._changed(level)
        self.number = 0
        while filled:
            wanted = part = 1 << (filled.bit_length() - 1)
            sequence = []
            while wanted:
                number, start, ids = row[0]
                sequence.append((number, start, ids[:wanted]))
                if len(ids) > wanted:
                    row[0] = (number, start + wanted, ids[wanted:])
                else:
                    row.pop(0)
                wanted -= len(sequence[-1][2])
            yield sequence
            filled -= part


class FastEncoder:
    """The ids of a vocabulary of this kind by the ``tiktoken`` library, for whole texts; the few texts that its search for
    pre-tokens refuses (very long white space) are encoded by ``Vocabulary``."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.made != sorted(vocabulary.made):
            raise ValueError("ids of this vocabulary are not in the order of its merges")
        self.vocabulary = vocabulary
        ids = {*vocabulary.first, *vocabulary.made}
        ranks = {vocabulary.strings[number]: number for number in ids}
        if len(ranks) < len(ids):
            raise ValueError("strings of this vocabulary repeat")
        self.library = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=vocabulary.special)

    def encode(self, text: str | None) -> np.ndarray:
        try:
            return self.library.encode_to_numpy(text or "", allowed_special="all").astype("<u4")
        except ValueError:
            return np.frombuffer(self.vocabulary.encode(text), "<u4")


_LOADED: dict[str, FastEncoder] = {}


def _encoder(shared: SharedVocabulary) -> FastEncoder:
    if shared.key not in _LOADED:
        data = json.loads(shared.content.value)
        if any(token[flag] for token in data["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens of this vocabulary take more than their own characters")
        _LOADED[shared.key] = FastEncoder(Vocabulary(shared.content.value))
    return _LOADED[shared.key]


def packed(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end: int = END,
    most_open: int = MOST_OPEN,
) -> DataFrame:
    """The pieces of all documents: ``doc_id``, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is the ids of its whole text (null: none; special strings as such) and the id ``end``.  What fills
    whole windows is cut off its front; the rest, shorter than a window, goes as one
    piece to the fill level that the sum of squares chooses.  Windows left open at the end of a task, or
    when more than ``most_open`` are, are closed by cutting further.  ``ids`` are little-endian unsigned
    32-bit integers; each id of a document lies in exactly one piece.  Sequences hold ``window`` ids, or fewer, always a power of two:
    none needs padding.

    Each task packs its own rows as it reads them, so nothing is shuffled and memory holds the open windows and one text.
    Sequence ids are unique, not consecutive.  Each row is a document, repeated rows too; a null id
    stays null; no rows give no pieces; other columns are ignored.
    """
    if window < 2:
        raise ValueError("a window has two ids at least")
    shared = SharedVocabulary(docs.sparkSession, path)
    texts = texts_of(docs, id_col, text_col)
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, levels = _encoder(shared), Levels(window, most_open)
        sequence = TaskContext.get().partitionId() << 33
        # Ids and lengths of the documents that open windows still hold pieces of.
        names: dict[int, tuple[object, int]] = {}
        left: dict[int, int] = {}
        kind, rows, waiting = None, [], 0

        def put(pieces: list[Piece]) -> None:
            nonlocal sequence, waiting
            offset = 0
            for number, start, ids in pieces:
                name, total = names[number]
                rows.append((name, start, len(ids), ids.tobytes(), total, sequence, offset))
                offset += len(ids)
                left[number] -= len(ids)
                if not left[number]:
                    del names[number], left[number]
            sequence += 1
            waiting += offset

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(column, one) for column, one in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        number = 0
        for batch in batches:
            kind = batch.column(0).type
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py()), np.array([end], "<u4"))
                names[number], left[number] = (name.as_py(), len(ids)), len(ids)
                whole = len(ids) - len(ids) % window
                for start in range(0, whole, window):
                    put([(number, start, ids[start : start + window])])
                    if waiting >= RETURNED_IDS:
                        yield batch_of()
                        rows, waiting = [], 0
                if whole < len(ids):
                    # A copy, so that an open window does not keep the rest of a long text.
                    for pieces in levels.place((number, whole, ids[whole:].copy())):
                        put(pieces)
                if waiting >= RETURNED_IDS:
                    yield batch_of()
                    rows, waiting = [], 0
                number += 1
        for pieces in levels.close():
            put(pieces)
        if rows:
            yield batch_of()

    fields = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return texts.mapInArrow(run, f"doc_id {id_type}, {fields}")
