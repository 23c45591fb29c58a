"""Exact top-k by inner product with a bit-sliced index."""

from __future__ import annotations

import heapq
import itertools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import staged

SCALE = 256
#: Rows of a block of the index, or fewer, so that making its bitmaps takes no more bytes than this.
BLOCK_ROWS = 1 << 13
BLOCK_BYTES = 1 << 27
#: Bits of an attribute that are kept as slices; the rest is made up for by exact scores of boundary rows.
SLICES = 5
#: Components of the index are integers up to this in size, or less for long vectors, so that scores fit into 64 bits.
LARGEST = 1 << 27
MOST = (1 << 63) - 1
#: Doubles from here on are integers.
WHOLE = 1 << 53
#: What a task gives for a block.  A score beyond 64 bits has its digits as text, and their number with its sign as side.
FOUND = {
    "query_id": pa.int64(), "query_row": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "side": pa.int32(), "digits": pa.string(),
}


class SlicedBlock:
    """The vectors of a block (``rows``, one per line) as bitmaps over its rows: one per attribute and bit."""

    def __init__(self, rows: np.ndarray, slices: int = SLICES):
        self.rows, (self.number, dims) = rows, rows.shape
        self.least = rows.min(axis=0) if self.number else np.zeros(dims, np.int64)
        above = rows - self.least
        largest = int(above.max(initial=0))
        self.dropped = max(0, largest.bit_length() - slices)
        self.bits = largest.bit_length() - self.dropped
        coarse = (above >> self.dropped).T
        words = -(-self.number // 64)
        planes = np.zeros((2, dims, self.bits, words * 64), bool)
        for bit in range(self.bits):
            planes[0, :, bit, : self.number] = coarse >> bit & 1
        # The other half holds complements: they count down, for negative weights.
        planes[1] = ~planes[0]
        self.planes = np.packbits(planes, axis=-1, bitorder="little").view(np.uint64)
        valid = np.zeros(words * 64, bool)
        valid[: self.number] = True
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum over attributes of |weight| times the coarse attribute, or its complement
        where the weight is negative."""
        size, negative = np.abs(query), (query < 0).astype(int)
        length = int(size.max(initial=0)).bit_length()
        columns: list[list[np.ndarray]] = [[] for _ in range(length + self.bits)]
        for shift in range(length):
            at = np.flatnonzero(size >> shift & 1)
            if len(at):
                for bit in range(self.bits):
                    columns[shift + bit].append(self.planes[negative[at], at, bit])
        slices, weight = [], 0
        while weight < len(columns):
            column = columns[weight]
            maps = np.concatenate(column) if column else np.zeros((0, len(self.valid)), np.uint64)
            while len(maps) > 1:
                # Full adders take three bitmaps at a time to a sum and a carry; a pair goes to a half adder.
                third = len(maps) // 3
                if third:
                    x, y, z = (maps[i * third : (i + 1) * third] for i in range(3))
                    odd = x ^ y
                    total, carry, rest = odd ^ z, x & y | odd & z, maps[3 * third :]
                else:
                    total, carry, rest = maps[:1] ^ maps[1:2], maps[:1] & maps[1:2], maps[2:]
                maps = np.concatenate([total, rest]) if len(rest) else total
                if weight + 1 == len(columns):
                    columns.append([])
                columns[weight + 1].append(carry)
            slices.append(maps[0] if len(maps) else np.zeros(len(self.valid), np.uint64))
            weight += 1
        return slices

    def possible(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """Places of all rows that can be among the ``wanted`` best."""
        wanted = min(wanted, self.number)
        slices = self.sums(query)
        left, need, worst = self.valid.copy(), wanted, 0
        for bit in reversed(range(len(slices))):
            ones = left & slices[bit]
            count = int(np.bitwise_count(ones).sum())
            if count >= need:
                left, worst = ones, worst | 1 << bit
            else:
                need -= count
                left &= ~slices[bit]
        # The dropped bits add between -(2^dropped - 1) * negative weights and the same times positive ones.
        spread = ((1 << self.dropped) - 1) * int(np.abs(query).sum())
        least = max(0, worst - (spread >> self.dropped) - 1) if spread else worst
        above, equal = np.zeros_like(self.valid), self.valid.copy()
        for bit in reversed(range(len(slices))):
            if least >> bit & 1:
                equal &= slices[bit]
            else:
                above |= equal & slices[bit]
                equal &= ~slices[bit]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: self.number])

    def best(self, query: np.ndarray, wanted: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the ``wanted`` best rows but those of id ``own``; ties to smaller ids."""
        mine = int((ids == own).sum())
        if self.number == mine:
            return ids[:0], ids[:0]
        at = self.possible(query, wanted + mine)
        at = at[ids[at] != own]
        scores = self.rows[at] @ query
        order = np.lexsort((ids[at], -scores))[:wanted]
        return ids[at][order], scores[order]


class FarRows:
    """Vectors of any finite components (``rows``): scored in doubles first, then in integers where doubles can't tell."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        self.light = _light(rows)
        # Twice what rounding, and what underflow of components and products, can add to a sum of so many terms.
        dims = rows.shape[1]
        self.slack = dims * 2.0**-51 * np.abs(self.light).sum(axis=1) + dims * 2.0**-1060

    def best(self, query: np.ndarray, wanted: int, own: int) -> tuple[np.ndarray, list[int]]:
        """Ids and exact scores of the ``wanted`` best rows but those of id ``own``; ties to smaller ids."""
        at = np.flatnonzero(self.ids != own)
        if len(at) > wanted:
            rough, slack = (self.light @ _light(query))[at], self.slack[at]
            least = np.partition(rough - slack, len(at) - wanted)[len(at) - wanted]
            at = at[rough + slack >= least]
        asked, scores, made = _integers(query), {}, []
        for place in at:
            row = self.rows[place]
            same = row.tobytes()
            if same not in scores:
                scores[same] = sum(map(operator.mul, asked, _integers(row)))
            made.append((-scores[same], int(self.ids[place])))
        made = heapq.nsmallest(wanted, made)
        return np.array([i for _, i in made], np.int64), [-score for score, _ in made]


def _light(values: np.ndarray) -> np.ndarray:
    """Divided by a power of two, so that none is above 1 in size."""
    return np.ldexp(values, -int(np.frexp(np.abs(values).max(initial=0))[1]))


def _integers(vector: np.ndarray) -> list[int]:
    # 256 times an integer may be more than a double holds.
    return [int(x) * SCALE if abs(x) >= WHOLE else int(x * SCALE) for x in vector.tolist()]


def scaled(vector: Column) -> Column:
    """floor(256 x) / 256, which a double holds exactly for each finite x."""
    parts = lambda x: F.floor(x * SCALE).cast("double") / SCALE
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) < WHOLE, parts(x.cast("double"))).otherwise(x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def _near(matrix: np.ndarray) -> np.ndarray:
    """Which vectors the index can hold."""
    limit = min(LARGEST, math.isqrt(MOST // max(1, matrix.shape[1])))
    return (np.abs(matrix) <= limit / SCALE).all(axis=1)


def _indexed(matrix: np.ndarray) -> np.ndarray:
    return (matrix * SCALE).astype(np.int64)


class Block:
    """The rows of a block, ready for its queries: the index, and beside it the rows that it can't hold."""

    def __init__(self, parts: list[pa.RecordBatch], dims: int, slices: int):
        self.dims = dims
        self.rows = np.concatenate([_matrix(part.column("vector"), dims) for part in parts])
        self.ids = np.concatenate([part.column("vec_id").to_numpy() for part in parts])
        near = _near(self.rows)
        self.near_ids = self.ids[near]
        self.index = SlicedBlock(_indexed(self.rows[near]), slices) if near.any() else None
        self.far = None if near.all() else FarRows(self.rows[~near], self.ids[~near])
        self.every: FarRows | None = None  # for queries that the index can't take

    def answers(self, queries: pa.RecordBatch, wanted: int) -> pa.RecordBatch:
        out = [[] for _ in FOUND]

        def put(own: int, row: int, ids: np.ndarray, scores: list[int]) -> None:
            for vec_id, score in zip(ids.tolist(), scores, strict=True):
                fits = -MOST <= score <= MOST
                digits = None if fits else str(abs(score))
                side = 0 if fits else len(digits) if score > 0 else -len(digits)
                for column, value in zip(out, (own, row, vec_id, score if fits else None, side, digits), strict=True):
                    column.append(value)

        asked = _matrix(queries.column("vector"), self.dims)
        owns, places = queries.column("vec_id").to_pylist(), queries.column("row_no").to_pylist()
        for own, row, query, easy in zip(owns, places, asked, _near(asked), strict=True):
            if not easy:
                self.every = self.every or FarRows(self.rows, self.ids)
                put(own, row, *self.every.best(query, wanted, own))
                continue
            if self.index is not None:
                found, scores = self.index.best(_indexed(query), wanted, self.near_ids, own)
                put(own, row, found, scores.tolist())
            if self.far is not None:
                put(own, row, *self.far.best(query, wanted, own))
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(out, FOUND.values(), strict=True)], list(FOUND))


def searched(wanted: int, slices: int):
    """Rows come sorted by block, those of the index before the queries, which are answered as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("dims", "block", "asks")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
                dims, number, asks = keys[:, start].tolist()
                if held != (dims, number):
                    held, parts, block = (dims, number), [], None
                part = batch.slice(start, end - start)
                if not asks:
                    parts.append(part)
                elif parts:
                    block = block or Block(parts, dims, slices)
                    yield block.answers(part, wanted)

    return run


def top_k(
    vectors: DataFrame,
    every: int = 50,
    wanted: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    slices: int = SLICES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``, ``whole_score``: the ``wanted`` best rows for each row whose id ``every`` divides.

    Components become floor(256 x); the score is the integer inner product,
    ties go to the smaller id.  Rows with the query's id are its own and not
    among its results.  Vectors that are null or hold null or non-finite
    components take no part, nor rows without id.  Components of any size are scored exactly: what is too large
    for the index is scored beside it, in integers of any length.  ``score`` is null beyond 64 bits;
    ``whole_score`` has each score's digits as text.  Vectors of
    another length than the query's don't meet it, empty ones score 0.  Repeated
    rows are candidates each, and a repeated query row gets its results again.
    Other columns are ignored.

    Each row is dealt to one block of about ``block_rows``, or fewer where vectors are long, by a hash of its place; queries
    go to every block.  A task makes the index of a block, answers the queries one batch after the other and
    passes on ``wanted`` rows for each.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.select("vec_id", scaled(F.col("vector")).alias("vector"), F.monotonically_increasing_id().alias("row_no"))
    rows = staged(rows.withColumn("dims", F.size("vector")), "vectors")
    # Of each length there are to be so many blocks that the bitmaps of one stay below BLOCK_BYTES.
    fit = F.greatest(F.lit(64), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_BYTES) / (2 * slices * F.greatest(F.lit(1), F.col("dims"))))))
    lengths = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"))
    blocks = lengths.agg(F.coalesce(F.max(F.ceil(F.col("n") / fit)), F.lit(1)).cast("int").alias("blocks")).first().blocks

    block = F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", block).withColumn("asks", F.lit(False))
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = rows.where(F.col("vec_id") % every == 0).withColumn("block", copies).withColumn("asks", F.lit(True))
    met = dealt.unionByName(asking).repartition(min(blocks, 1 << 15), "dims", "block").sortWithinPartitions("dims", "block", "asks")
    found = met.mapInArrow(searched(wanted, slices), "query_id long, query_row long, vec_id long, score long, side int, digits string")
    above, below = F.when(F.col("side") > 0, F.col("digits")), F.when(F.col("side") < 0, F.col("digits"))
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("side"), F.desc("score"), F.desc(above), below, "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted)
    whole = F.coalesce(F.col("score").cast("string"), above, F.concat(F.lit("-"), below)).alias("whole_score")
    return ranked.select("query_id", "rank", "vec_id", "score", whole)
