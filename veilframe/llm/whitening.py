"""Whitening of embeddings with components from spectral divide and conquer."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.session import staged

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Entries from here on have no exact place on the scale.
LARGEST = 2.0**53
#: Rows whose products are summed at once, and bits of a limb: such sums are exact in doubles.
ROWS = 1 << 11
LIMB = 20
#: Partial sums meet in so many groups first.
GROUPS = 64
#: Directions with less than this part of the first eigenvalue are not told from rounding.
RANK = 1e-11
EPS = float(np.finfo(np.float64).eps)


# --- spectral divide and conquer on the driver's small matrix ------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps: it has the matrix's eigenvectors,
    and the signs of its eigenvalues."""
    size = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * math.sqrt(size))
    except np.linalg.LinAlgError:
        low = EPS
    low = min(1.0, max(EPS, low))
    unit = np.eye(size)
    for _ in range(30):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        a_k = math.sqrt(1 + d) + math.sqrt(8 - 4 * d + 8 * (2 - square) / (square * math.sqrt(1 + d))) / 2
        b_k = (a_k - 1) ** 2 / 4
        c_k = a_k + b_k - 1
        if c_k > 100:
            q = np.linalg.qr(np.vstack([math.sqrt(c_k) * x, unit]))[0]
            new = b_k / c_k * x + (a_k - b_k / c_k) / math.sqrt(c_k) * q[:size] @ q[size:].T
        else:
            new = b_k / c_k * x + (a_k - b_k / c_k) * np.linalg.solve(unit + c_k * x @ x, x)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (a_k + b_k * square) / (1 + c_k * square))
        if moved < 1e-14 * math.sqrt(size) or (1 - low < 10 * EPS and moved < 1e-6):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces, the eigenvalues of one above those of the other; None where all are alike."""
    size, scale = len(a), np.linalg.norm(a)
    diagonal = np.diag(a)
    spread = np.linalg.norm(a - diagonal.mean() * np.eye(size))
    if spread <= 4 * EPS * scale:
        return None
    start = np.random.default_rng(size).standard_normal((size, size))
    best = None
    # A shift near an eigenvalue leaves that one on neither side, so there are several.
    for shift in (np.median(diagonal), *(diagonal.mean() + spread / math.sqrt(size) * t for t in (0, 0.173, -0.191, 0.547, -0.613, 0.031, -0.037))):
        moved = a - shift * np.eye(size)
        if np.linalg.norm(moved) <= 4 * EPS * scale:
            continue
        projector = (polar(moved) + np.eye(size)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < size:
            continue
        basis = np.linalg.qr(projector @ start[:, :rank])[0]
        whole = np.linalg.qr(projector @ basis, mode="complete")[0]
        above, below = whole[:, :rank], whole[:, rank:]
        left = np.linalg.norm(below.T @ a @ above)
        if best is None or left < best[0]:
            best = left, above, below
        if left <= 8 * EPS * scale * math.sqrt(size):
            break
    # Eigenvalues too close to be told apart leave any basis as good as another.
    return None if best is None else best[1:]


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors in columns."""
    whole = (a + a.T) / 2
    found, waiting = [], [(np.eye(len(a)), whole)]
    while waiting:
        basis, part = waiting.pop()
        both = split(part) if len(part) > 1 else None
        if both is None:
            found.append(basis)
            continue
        waiting += [(basis @ side, (inner + inner.T) / 2) for side in both for inner in [side.T @ part @ side]]
    vectors = np.linalg.qr(np.hstack(found))[0] if found else whole
    values = np.einsum("ij,ik,kj->j", vectors, whole, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- exact sums over all rows --------------------------------------------------


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of ``values``, arrays of integers as text, by ``keys``: in groups of tasks first, then over these."""

    def run(table: pa.Table) -> pa.Table:
        total: list[int] = []
        for one in table.column("values"):
            numbers = map(int, one.as_py())
            total = list(map(int.__add__, total, numbers)) if total else list(numbers)
        head = {name: table.column(name)[:1] for name in table.column_names if name != "values"}
        return pa.table(head | {"values": pa.array([list(map(str, total))], pa.list_(pa.string()))})

    for more in (["part"], []):
        rows = rows.select(*keys, *more, "values")
        rows = rows.groupBy(*keys, *more).applyInArrow(run, rows.schema)
    return rows


def _part() -> int:
    return TaskContext.get().partitionId() % GROUPS


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length of vectors in a batch: the places and the matrix of those rows."""
    lengths = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == dims)
        yield dims, places, _matrix(batch.column(at).take(pa.array(places)), dims)


def _record(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], list(columns))


def totals(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sums of their entries, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for dims, _, matrix in _by_length(batch, 0):
                # High and low halves, as the sum of whole entries may not fit.
                halves = [(matrix >> 32).sum(axis=0).tolist(), (matrix & 0xFFFFFFFF).sum(axis=0).tolist()]
                own = [len(matrix), *((high << 32) + low for high, low in zip(*halves, strict=True))]
                sums[dims] = list(map(int.__add__, sums[dims], own)) if dims in sums else own
        values = [list(map(str, one)) for one in sums.values()]
        yield _record({"dims": (list(sums), pa.int32()), "part": ([_part()] * len(sums), pa.int32()), "values": (values, pa.list_(pa.string()))})

    found = vectors.select("vector").mapInArrow(run, "dims int, part int, values array<string>")
    rows = ((row.dims, list(map(int, row["values"]))) for row in _summed(found, ["dims"]).collect())
    return {dims: (own[0], own[1:]) for dims, own in sorted(rows)}


def _limbs(matrix: np.ndarray) -> list[np.ndarray]:
    """Doubles that add up to an integer matrix, the k-th in units of 2^(20 k) and below 2^20 of them in size."""
    out = []
    while True:
        if np.abs(matrix).max(initial=0) < 1 << LIMB:
            return [*out, matrix.astype(np.float64)]
        out.append((matrix & (1 << LIMB) - 1).astype(np.float64))
        matrix = matrix >> LIMB


def products(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, list[list[int]]]:
    """Sums of x x^T over all vectors x less the whole part of their mean, by length, as exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, _, matrix in _by_length(batch, 0):
                own = sums.setdefault(dims, np.zeros((dims, dims), object))
                for start in range(0, len(matrix), ROWS):
                    limbs = _limbs(matrix[start : start + ROWS] - centres[dims])
                    for i, one in enumerate(limbs):
                        for j, other in enumerate(limbs):
                            own += (one.T @ other).astype(np.int64).astype(object) << LIMB * (i + j) if i + j else (one.T @ other).astype(np.int64)
        for dims, own in sums.items():
            values = [[str(x) for x in line] for line in own.tolist()]
            yield _record(
                {
                    "dims": ([dims] * dims, pa.int32()), "line": (list(range(dims)), pa.int32()),
                    "part": ([_part()] * dims, pa.int32()), "values": (values, pa.list_(pa.string())),
                }
            )

    found = vectors.select("vector").mapInArrow(run, "dims int, line int, part int, values array<string>")
    sums: dict[int, list[list[int]]] = {dims: [[]] * dims for dims in centres}
    for row in _summed(found, ["dims", "line"]).collect():
        sums[row.dims][row.line] = list(map(int, row["values"]))
    return sums


@dataclass(frozen=True)
class Whitener:
    """What is needed to whiten vectors of one length."""

    number: int
    whole: np.ndarray  # the mean's whole part
    rest: list[int]  # and what is left of the sums
    directions: np.ndarray  # unit eigenvectors in columns, over the roots of their eigenvalues
    explained: np.ndarray

    def apply(self, matrix: np.ndarray) -> np.ndarray:
        part = np.array([r / self.number for r in self.rest])
        return ((matrix - self.whole).astype(np.float64) - part) @ self.directions

    def deviations(self, matrix: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exactly; None beyond 64 bits."""
        centred = matrix - self.whole
        bound = (int(np.abs(centred).max(initial=0)) + 1) * self.number
        if bound * bound * matrix.shape[1] < 1 << 63:
            own = centred * self.number - np.array(self.rest, np.int64)
            return (own * own).sum(axis=1).tolist()
        sums = [sum((x * self.number - r) ** 2 for x, r in zip(line, self.rest, strict=True)) for line in centred.tolist()]
        return [one if one < 1 << 63 else None for one in sums]


def fitted(number: int, whole: np.ndarray, rest: list[int], sums: list[list[int]], components: int) -> Whitener:
    """Covariances are rounded once: (n G - r r^T) / n^2 with integers G and r."""
    square = number * number
    lines = [[(number * g - a * b) / square for g, b in zip(line, rest, strict=True)] for line, a in zip(sums, rest, strict=True)]
    covariance = np.array(lines, np.float64).reshape(len(rest), len(rest))
    trace = sum(number * line[i] - rest[i] * rest[i] for i, line in enumerate(sums)) / square
    if not trace:
        return Whitener(number, whole, rest, np.zeros((len(rest), 0)), np.zeros(0))
    values, vectors = spectrum(covariance)
    kept = int(np.count_nonzero(values[:components] > RANK * values[0]))
    return Whitener(number, whole, rest, vectors[:, :kept] / np.sqrt(values[:kept]), values[:kept] / trace)


def identity_error(vectors: DataFrame, models: dict[int, Whitener]) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over all lengths."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, _, matrix in _by_length(batch, 0):
                own = shared.value[dims].apply(matrix)
                both = np.vstack([own.T @ own, own.sum(axis=0)])
                sums[dims] = sums[dims] + both if dims in sums else both
        shapes, lines, values = [], [], []
        for dims, own in sums.items():
            shapes += [dims] * len(own)
            lines += range(len(own))
            values += own.tolist()
        yield _record(
            {
                "dims": (shapes, pa.int32()), "line": (lines, pa.int32()),
                "part": ([_part()] * len(lines), pa.int32()), "values": (values, pa.list_(pa.float64())),
            }
        )

    def added(table: pa.Table) -> pa.Table:
        total = [math.fsum(column) for column in zip(*table.column("values").to_pylist(), strict=True)]
        head = {name: table.column(name)[:1] for name in table.column_names if name != "values"}
        return pa.table(head | {"values": pa.array([total], pa.list_(pa.float64()))})

    found = vectors.select("vector").mapInArrow(run, "dims int, line int, part int, values array<double>")
    for keys in (["dims", "line", "part"], ["dims", "line"]):
        found = found.select(*keys, "values")
        found = found.groupBy(*keys).applyInArrow(added, found.schema)
    sums: dict[int, dict[int, list[float]]] = {}
    for row in found.collect():
        sums.setdefault(row.dims, {})[row.line] = row["values"]
    worst = 0.0
    for dims, lines in sums.items():
        number, kept = models[dims].number, models[dims].directions.shape[1]
        if kept:
            mean = np.array(lines[kept]) / number
            covariance = np.array([lines[i] for i in range(kept)]) / number - np.outer(mean, mean)
            worst = max(worst, float(np.abs(covariance - np.eye(kept)).max()))
    return worst


def usable(vector: Column) -> Column:
    """Not null, and every entry a number that has its place on the scale."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(LARGEST / SCALE), F.lit(False)))
    return F.coalesce(fits, F.lit(False))


def whitened(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` of every usable vector.

    Entries c become x = floor(64 c) + 1,000,000.  All usable vectors are the fit list: their covariance, exact until it is rounded
    once, is split by polar decompositions of its shifts into ever smaller invariant subspaces, on the driver, where it must fit.
    Components are its unit eigenvectors by falling eigenvalue, at most ``components`` of them; those with less than 1e-11 of the first
    eigenvalue are rounding and left out, so vectors that are all alike have no rows.  ``deviation``
    is the sum of (n x - S)^2, null beyond 64 bits.

    Vectors that are null or hold null or non-finite entries take no part, nor do those with entries of 2^47 or more, which
    doubles don't place on the scale.  Vectors of another length are a fit list of their own; ``identity_error`` is
    the worst of all.  A null id stays null, each repeated row counts, other columns are ignored, no rows give no rows.

    Tasks send sums, not rows; the model (at most ``components`` directions) is broadcast.  Nothing of the rows is shuffled.
    """
    spark = vectors.sparkSession
    known = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    place = lambda x: F.floor(x.cast("double") * SCALE).cast("long") + SHIFT
    rows = staged(known.select("vec_id", F.transform("vector", place).alias("vector")).where(F.size("vector") > 0), "vectors")

    counted = totals(rows)
    wholes = {dims: np.array([s // n for s in sums], np.int64) for dims, (n, sums) in counted.items()}
    gram = products(rows, wholes)
    models = {
        dims: fitted(n, wholes[dims], [s - n * q for s, q in zip(sums, wholes[dims].tolist(), strict=True)], gram[dims], components)
        for dims, (n, sums) in counted.items()
    }
    error = identity_error(rows, models)
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, places, matrix in _by_length(batch, 1):
                model = shared.value[dims]
                kept = len(model.explained)
                deviations = model.deviations(matrix)
                again = np.repeat(np.arange(len(places)), kept)
                arrays = [
                    batch.column(0).take(pa.array(places[again])),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(places))),
                    pa.array(np.full(len(again), model.number)),
                    pa.array(deviations, pa.int64()).take(pa.array(again)),
                    pa.array(model.apply(matrix).ravel()),
                    pa.array(np.tile(model.explained, len(places))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    fields = "component int, n long, deviation long, whitened double, explained double"
    return rows.select("vec_id", "vector").mapInArrow(run, f"vec_id {id_type}, {fields}").withColumn("identity_error", F.lit(error))
