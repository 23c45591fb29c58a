"""A quality classifier over random-indexing word vectors."""

from __future__ import annotations

import itertools
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.batches import per_text, texts_of
from veilframe.llm.exact import merged
from veilframe.session import staged

#: A word that makes up more than 1/OWN of all has a vector of its own; the others share so many by a hash.
OWN = 1 << 16
SHARED = 1 << 12
#: Numbers of a vector.
DIMS = 32
#: Non-zero entries of a word's index vector, and how far its neighbours reach.
ENTRIES = 4
WINDOW = 2
#: Labelled rows the network may learn from, and its hidden units.
LABELLED = 20_000
HIDDEN = 32
THRESHOLD = 0.3
# Rows of the matrix of word vectors that move together, and partial sums of each.
SLAB = 256
SALTS = 16
# Words looked at once, and words a worker remembers, up to this length.
CHUNK = 1 << 16
CACHED = 1 << 18
LONGEST = 64

_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


_MARKS = frozenset(".,;:!?")


def tokens_of(word: str) -> tuple[str, ...] | list[str]:
    """What ``_TOKENS`` finds in a word; one of letters alone, with a mark behind it or not, needs no search."""
    if word.isalpha():
        return (word,)
    if word[-1] in _MARKS and word[:-1].isalpha():
        return word[:-1], word[-1]
    return _TOKENS.findall(word)


def shape(token: str) -> str:
    """Case counts only where all letters are capitals."""
    return token if len(token) > 1 and token.isupper() else token.lower()


class Words(dict):
    """The vector numbers of the tokens of each word between white space: ``own`` tokens in their order, then the shared
    numbers."""

    def __init__(self, own: list[str]):
        super().__init__()
        self.key = uuid.uuid4().hex
        self.own = {word: number for number, word in enumerate(own)}

    @property
    def kind(self) -> str:
        """The least whole numbers that hold all vector numbers."""
        return "<u2" if rows_of(self) <= 1 << 16 else "<u4"

    def number(self, token: str) -> int:
        word = shape(token)
        number = self.own.get(word)
        return len(self.own) + zlib.crc32(word.encode("utf-8", "replace")) % SHARED if number is None else number

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(map(self.number, tokens_of(word)))
        if len(self) >= CACHED:
            self.clear()
        if len(word) <= LONGEST:
            self[word] = found
        return found

    def __reduce__(self):
        return _words, (self.key, list(self.own))


_KNOWN: dict[str, Words] = {}


def _words(key: str, own: list[str]) -> Words:
    """One table of a worker for each key, so that what it remembers serves later tasks."""
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Words(own)
        _KNOWN[key].key = key
    return _KNOWN[key]


def frequent_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task: tokens with a share of 1/(32 ``OWN``) of its tokens or more, and the number of all (``word`` null).

    No token holds white space, so words between it are counted and cut afterwards.  A
    Misra-Gries summary bounds what is kept; words over ``LONGEST`` have no vectors of their own.
    """
    counts, others = Counter(), 0
    for batch in batches:
        for text in batch.column(0):
            found = (text.as_py() or "").split()
            short = [word for word in found if len(word) <= LONGEST]
            others += len(found) - len(short)
            counts.update(short)
            if len(counts) > 8 * OWN:
                others += sum(counts.values())
                counts = merged(counts, 4 * OWN)
                others -= sum(counts.values())
    words: Counter = Counter()
    for word, n in counts.items():
        for token in tokens_of(word):
            words[shape(token)] += n
    total = others + sum(words.values())
    rows = [(word, n) for word, n in words.items() if n * 32 * OWN > total]
    yield pa.RecordBatch.from_arrays(
        [pa.array([None, *(word for word, _ in rows)], pa.string()), pa.array([total, *(n for _, n in rows)], pa.int64())], ["word", "seen"]
    )


def own_words(texts: DataFrame) -> list[str]:
    """The words with vectors of their own, fewer than ``OWN``."""
    seen = texts.select("text").mapInArrow(frequent_shapes, "word string, seen long")
    seen = staged(seen.groupBy("word").agg(F.sum("seen").alias("seen")), "words")
    total = seen.where("word is null").select("seen").scalar()
    return sorted(row.word for row in seen.where("word is not null").where(F.col("seen") * OWN > total).select("word").collect())


def numbers(text: str | bytes | None, words: Words) -> Iterator[np.ndarray]:
    """The vector numbers of all tokens of a whole text, in chunks that share ``WINDOW`` tokens.  ``text`` may be what
    :func:`packed` made of it."""
    if not text:
        return
    if isinstance(text, bytes):
        known = np.frombuffer(text, words.kind)
        for start in range(0, len(known), CHUNK):
            yield known[max(0, start - WINDOW) : start + CHUNK].astype(np.int64)
        return
    parts, shared = text.split(), np.zeros(0, np.int64)
    for start in range(0, len(parts), CHUNK):
        chunk = map(words.__getitem__, parts[start : start + CHUNK])
        ids = np.concatenate([shared, np.fromiter(itertools.chain.from_iterable(chunk), np.int64)])
        yield ids
        shared = ids[-WINDOW:]


def packed(text: str | None, words: Words) -> bytes:
    """The vector numbers of all tokens of a whole text, as bytes."""
    fresh, out = 0, []
    for ids in numbers(text, words):
        out.append(ids[fresh:].astype(words.kind).tobytes())
        fresh = min(len(ids), WINDOW)
    return b"".join(out)


def numbered(texts: DataFrame, words: Words) -> DataFrame:
    """``texts`` with the numbers of its tokens as ``text``, worked out once for all steps that read them: in vocabularies that grow
    with the texts, looking words up costs far more than all that is made of their numbers."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def make():
        known = shared.value
        return lambda text: (packed(text, known),)

    return staged(per_text(texts, make, "text binary"), "word-numbers")


def rows_of(words: Words) -> int:
    """Numbers in use, filled up to whole slabs."""
    return -(-(len(words.own) + SHARED) // SLAB) * SLAB


def index_vectors(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each word's random index vector."""
    random = np.random.default_rng(20)
    return random.integers(0, DIMS, (rows, ENTRIES)), random.choice([-1.0, 1.0], (rows, ENTRIES))


def context_sums(words: Words):
    """For each word the sum of the index vectors of its neighbours in a task's texts, in slabs of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(words)
        places, signs = (np.ascontiguousarray(one.T) for one in index_vectors(rows))
        sums, held, size = np.zeros(rows * DIMS, np.int64), [], 0

        def add(pairs):
            own, near = (np.concatenate(x) for x in zip(*pairs, strict=True))
            first = own * DIMS
            for entry in range(ENTRIES):
                # Sums of so few signs are exact in doubles.
                sums[:] += np.bincount(first + places[entry][near], signs[entry][near], rows * DIMS).astype(np.int64)

        for batch in batches:
            for text in batch.column(0):
                fresh = 0
                for ids in numbers(text.as_py(), words):
                    for distance in range(1, WINDOW + 1):
                        # Pairs that lie within the tokens shared with the chunk before have been counted.
                        a, b = ids[max(0, fresh - distance) : -distance], ids[max(distance, fresh) :]
                        held += [(a, b), (b, a)]
                        size += 2 * len(a)
                    fresh = WINDOW
                if size > 1 << 22:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        slabs = sums.reshape(-1, SLAB * DIMS)
        for at in np.flatnonzero(np.abs(slabs).sum(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([slabs[at].astype("<i8").tobytes()], pa.binary())], ["slab", "sums"])

    return run


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slab, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[slab] = sums.get(slab, 0) + np.frombuffer(part, "<i8")
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())],
        ["slab", "sums"],
    )


def word_vectors(texts: DataFrame, words: Words) -> np.ndarray:
    """Unit word vectors from the neighbours of every word in all ``texts`` (column ``text``, packed or not).

    Tasks pass on sums in slabs of a fixed number of words, which are added in
    two steps, so neither the number of texts nor of tasks reaches one place.  Sums are integers, so their order makes no
    difference.  The result has fewer than ``OWN`` and ``SHARED`` rows together, at most 10 MB, whatever the corpus.
    """
    fields = "slab int, sums binary"
    parts = texts.select("text").mapInArrow(context_sums(words), fields)
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    partly = salted.repartition("slab", "salt").select("slab", "sums").mapInArrow(added, fields)
    sums = np.zeros((rows_of(words) // SLAB, SLAB * DIMS), np.int64)
    for row in partly.repartition("slab").mapInArrow(added, fields).collect():
        sums[row.slab] += np.frombuffer(row.sums, "<i8")
    vectors = sums.reshape(-1, DIMS).astype(np.float64)
    # Common words add the same to all, so take off the mean; words never seen stay zero.
    seen = np.abs(vectors).sum(axis=1) > 0
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    if seen.any():
        vectors[seen] -= vectors[seen].mean(axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32)


FEATURES = 2 * DIMS + 2


def pooled(text: str | bytes | None, vectors: np.ndarray, words: Words) -> np.ndarray:
    """Mean and spread of a whole text's word vectors, the mean likeness of neighbours, and the length; zeros without tokens."""
    total, squares, alike, count, pairs, fresh = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0, 0, 0
    for ids in numbers(text, words):
        # Plain products of single-precision matrices, a chunk at a time; chunks add up in doubles.
        rows = vectors[ids]
        own = rows[fresh:]
        ones = np.ones(len(own), np.float32)
        total += ones @ own
        squares += ones @ (own * own)
        near = rows[max(0, fresh - 1) :]
        alike += float(near[1:].ravel() @ near[:-1].ravel())
        count, pairs, fresh = count + len(own), pairs + len(near) - 1, WINDOW
    if not count:
        return np.zeros(FEATURES)
    mean = total / count
    spread = np.sqrt(np.maximum(squares / count - mean**2, 0))
    return np.concatenate([mean, spread, [alike / max(1, pairs), np.log1p(count) / 10]])


class Network:
    """Two layers, trained by Adam, with probabilities calibrated by a temperature."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, epochs: int = 80):
        random = np.random.default_rng(5)
        self.key = uuid.uuid4().hex
        self.base = float(labels.mean()) if len(labels) else 0.5
        self.temperature = 1.0
        self.layers = None
        if len(set(labels.tolist())) < 2:
            return
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-6
        order = random.permutation(len(labels))
        # A fifth of the rows sets the temperature.
        kept, fit = order[: len(order) // 5], order[len(order) // 5 :]
        inputs = (features - self.mean) / self.scale
        width = features.shape[1]
        layers = [random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in layers]
        step = 0
        for _ in range(epochs):
            for at in np.array_split(random.permutation(fit), max(1, len(fit) // 256)):
                x, y = inputs[at], labels[at]
                hidden = np.tanh(x @ layers[0] + layers[1])
                wrong = (_sigmoid(hidden @ layers[2] + layers[3][0]) - y) / len(at)
                back = np.outer(wrong, layers[2]) * (1 - hidden**2)
                slopes = [x.T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ wrong + 1e-4 * layers[2], wrong.sum(keepdims=True)]
                step += 1
                for layer, slope, (first, second) in zip(layers, slopes, moments, strict=True):
                    first += 0.1 * (slope - first)
                    second += 0.001 * (slope**2 - second)
                    rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    layer -= rate * first / (np.sqrt(second) + 1e-8)
        self.layers = layers
        if len(kept):
            logits = self._logits(features[kept])
            trials = np.exp(np.linspace(-1.5, 3, 91))
            losses = [np.mean(np.logaddexp(0, logits / t) - labels[kept] * logits / t) for t in trials]
            self.temperature = float(trials[int(np.argmin(losses))])

    def _logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.mean) / self.scale @ self.layers[0] + self.layers[1])
        return hidden @ self.layers[2] + self.layers[3][0]

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(features), self.base)
        return _sigmoid(self._logits(features) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def trained(texts: DataFrame, labels: DataFrame, vectors, most: int = LABELLED) -> Network:
    """A network from at most ``most`` labelled rows that are not held out, chosen by a hash of their ids among all."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")

    def make():
        shared, words = vectors.value
        return lambda text: (pooled(text, shared, words).tolist(),)

    found = per_text(rows, make, "features array<double>").orderBy("doc_id").limit(most).toArrow()
    marked = dict(zip(*(column.to_pylist() for column in chosen.toArrow().columns), strict=True))
    ids = found.column("doc_id").to_pylist()
    features = np.array(found.column("features").to_pylist(), float).reshape(len(ids), FEATURES)
    return Network(features, np.array([marked[x] for x in ids], float))


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of ``docs``.

    Word vectors come from all texts: each word adds up the random index
    vectors of its neighbours.  Words that make up more than 1/``OWN`` of all tokens have vectors of their own, rarer ones share ``SHARED`` by a hash.  A document pools the vectors of its whole text; a
    network of two layers turns that into the probability of label 1 (``quality`` in ``labels``),
    learned from at most ``most`` rows outside the held-out fold.  ``predicted`` is 1 from a score of 0.3 on.
    A null or empty text pools to zeros and is scored like any other; without labels
    of both kinds the score is the share of ones, without labels 0.5.  A row
    without id is scored, never learned from or held out.  Labels other than 0 and 1 are ignored; of several for
    one id the largest counts.  Rows stay as they are, repeated ones too; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    texts = texts_of(docs, id_col, text_col)
    words = Words(own_words(texts))
    texts = numbered(texts, words)
    vectors = context.broadcast((word_vectors(texts, words), words))
    network = context.broadcast(trained(texts, labels, vectors, most))

    def make():
        (shared, words), model = vectors.value, network.value
        return lambda text: (float(model.scores(pooled(text, shared, words)[None, :])[0]),)

    scored = per_text(texts, make, "score double")
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
