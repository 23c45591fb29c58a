"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.batches import per_text, per_value, texts_of
from veilframe.llm.components import components
from veilframe.operators.skew import join_skewed
from veilframe.session import staged

SHINGLE_WORDS = 3
MAX_BITS = 2
#: Members of an anchor's cell that are compared with each other; larger cells are dealt to finer anchors.
CELL_LIMIT = 2048
#: Cells are counted in so many groups to find those that would fill a task.
COUNTED = 1 << 18
# Rows compared at once.
BLOCK = 1 << 18
# Shingles hashed at once.
CHUNK = 1 << 16

_HASH = xxhash.xxh64_intdigest
# For each byte a word of eight byte lanes, lane i being its bit i: sums of up
# to 255 of them count bits without carry from lane to lane.
_LANES = np.array([sum(((byte >> bit) & 1) << (8 * bit) for bit in range(8)) for byte in range(256)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text as a signed integer; without words 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    ones, count = np.zeros(64, np.int64), len(words) - width + 1
    for start in range(0, count, CHUNK):
        part = words[start : start + CHUNK + width - 1]
        shingles = part if width == 1 else map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        hashes = np.fromiter(map(_HASH, shingles, repeat(42)), np.uint64)
        lanes = _LANES[hashes.view(np.uint8)].reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``fp`` of each row of ``docs`` (``doc_id``, ``text``)."""
    return per_text(docs, lambda: lambda text: (fingerprint(text, width),), "fp long")


# --- anchors -----------------------------------------------------------------


def error_patterns(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, the differences of up to ``radius`` bits between a 32-bit word and an anchor; and their number.

    Anchors are the words whose set bit positions 0..31 have XOR 0: the Hamming
    code of length 31 with one free bit.  Every word is at most one bit from an
    anchor (flip the bit at its syndrome), so the covering radius is 1.
    """
    found: list[list[int]] = [[] for _ in range(32)]
    for weight in range(radius + 1):
        for places in combinations(range(32), weight):
            syndrome = 0
            for place in places:
                syndrome ^= place
            found[syndrome].append(sum(1 << place for place in places))
    counts = np.array([len(x) for x in found])
    table = np.zeros((32, counts.max()), np.uint64)
    for row, patterns in zip(table, found, strict=True):
        row[: len(patterns)] = patterns
    return table, counts


_PLACES = [np.uint64(sum(1 << place for place in range(32) if place >> bit & 1)) for bit in range(5)]


def syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for bit, mask in enumerate(_PLACES):
        out |= (np.bitwise_count(words & mask).astype(np.int64) & 1) << bit
    return out


def anchor_copies(max_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Copies of fingerprints (``fp``) for all anchors near enough: ``cell``, ``probe``, ``fp``.

    Two fingerprints that differ in at most k bits differ in at most s bits of
    the low half, or in at most k - 1 - s of the high half.  In that half, the
    anchor nearest to one of them (its home) lies within the covering radius
    plus that bound of the other, so both have a copy in that anchor's cell.
    """
    near = (max_bits - 1) // 2
    tables = [error_patterns(1 + near), error_patterns(1 + max_bits - 1 - near)]

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(fps):
                continue
            words = fps.view(np.uint64)
            cells, probes, copies = [], [], []
            for half, (patterns, counts) in enumerate(tables):
                part = words >> np.uint64(32) if half else words & np.uint64(0xFFFFFFFF)
                at = syndromes(part)
                home = part ^ np.where(at > 0, np.uint64(1) << at.astype(np.uint64), np.uint64(0))
                anchors = part[:, None] ^ patterns[at]
                real = np.arange(patterns.shape[1])[None, :] < counts[at][:, None]
                cells.append((anchors[real] | np.uint64(half << 32)).view(np.int64))
                probes.append((anchors != home[:, None])[real])
                copies.append(np.broadcast_to(fps[:, None], real.shape)[real])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (cells, probes, copies)], ["cell", "probe", "fp"]
            )

    return run


def ball_copies(max_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Copies for the code of radius 0, whose anchors are all 64-bit words.

    Each fingerprint goes to the words within half of ``max_bits`` (rounded
    up).  Two that are near enough share the word halfway, and a cell holds at
    most as many fingerprints as there are such words (65 for 2 bits).
    """
    masks = np.array(
        [sum(1 << b for b in bits) for w in range((max_bits + 1) // 2 + 1) for bits in combinations(range(64), w)],
        np.uint64,
    )

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start in range(0, len(fps), 4096):
                part = fps[start : start + 4096]
                cells = part.view(np.uint64)[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cells.reshape(-1).view(np.int64)),
                        pa.array(np.zeros(cells.size, bool)),
                        pa.array(np.repeat(part, len(masks))),
                    ],
                    ["cell", "probe", "fp"],
                )

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links ``a[i]`` - ``b[i]``: the members and their smallest member."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        least = np.minimum(lu, lv)
        new = label.copy()
        for at in (u, v, lu, lv):
            np.minimum.at(new, at, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def cell_links(cells: np.ndarray, probes: np.ndarray, fps: np.ndarray, max_bits: int):
    """Links inside the cells of sorted rows, as stars.  Of two linked rows one at least is at home, so homes come first."""
    first, kept_a, kept_b = np.flatnonzero(~probes), [], []
    words, held = fps.view(np.uint64), 0
    offset = 1
    while len(first):
        first = first[first + offset < len(cells)]
        first = first[cells[first + offset] == cells[first]]
        near = first[np.bitwise_count(words[first] ^ words[first + offset]) <= max_bits]
        near = near[fps[near] != fps[near + offset]]
        kept_a.append(fps[near])
        kept_b.append(fps[near + offset])
        held += len(near)
        if held > 1 << 21:
            a, b = forest(np.concatenate(kept_a), np.concatenate(kept_b))
            kept_a, kept_b, held = [a], [b], len(a)
        offset += 1
    return forest(np.concatenate(kept_a), np.concatenate(kept_b)) if held else (fps[:0], fps[:0])


def compare_cells(max_bits: int, limit: int | None):
    """Over rows sorted by cell: ``a``, ``b`` links; members of cells above ``limit`` come back with ``b`` null."""

    def out(a, b=None):
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
        return pa.RecordBatch.from_arrays([pa.array(a), b], ["a", "b"])

    def run(batches):
        full = None  # the cell that has been found too large
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle(parts, last):
            nonlocal full
            cells, probes, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            if full is not None:
                more = cells == full
                if more.any():
                    yield out(fps[more])
                    cells, probes, fps = cells[~more], probes[~more], fps[~more]
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.array([], int)
            sizes = np.diff(np.r_[starts, len(cells)])
            keep = len(cells)
            if not last and len(starts):
                keep = starts[-1]
            if limit is not None and len(sizes) and sizes.max() > limit:
                if sizes[-1] > limit:
                    full, keep = cells[-1], len(cells)
                large = np.repeat(sizes > limit, sizes)
                yield out(fps[large])
            else:
                large = np.zeros(len(cells), bool)
            small = ~large[:keep]
            a, b = cell_links(cells[:keep][small], probes[:keep][small], fps[:keep][small], max_bits)
            if len(a):
                yield out(a, b)
            held[:] = [(cells[keep:], probes[keep:], fps[keep:])] if keep < len(cells) else []

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            if sum(len(x[0]) for x in held) >= BLOCK:
                yield from settle(held, False)
        if held:
            yield from settle(held, True)

    return run


COPY = "cell long, probe boolean, fp long"
LINK = "a long, b long"


def links(distinct: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """``a``, ``b``: links whose components are those of all pairs of ``distinct`` fingerprints (``fp``) within ``max_bits``.

    Of each cell the links come as stars, so their number is linear in the
    copies.  Cells are counted in groups first; members of groups that hold far
    more than their share, and of cells above ``cell_limit``, are dealt to
    finer anchors, whose cells are small by construction.
    """
    spark = distinct.sparkSession
    if max_bits < 1:
        return spark.createDataFrame([], LINK)
    copies = distinct.select("fp").mapInArrow(anchor_copies(max_bits), COPY)
    group = F.pmod(F.xxhash64("cell"), F.lit(COUNTED))
    counts = staged(copies.groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n")), "cells")
    # At most COUNTED / 8 groups can hold eight times the mean.
    bound = counts.agg(F.greatest(F.lit(cell_limit), (8 * F.sum("n") / COUNTED).cast("long"))).scalar()
    heavy = F.broadcast(counts.where(F.col("n") > bound).select("grp"))
    grouped = copies.withColumn("grp", group)
    found = staged(_compared(grouped.join(heavy, "grp", "left_anti").drop("grp"), max_bits, cell_limit), "found")
    large = found.where("b is null").select(F.col("a").alias("fp"))
    large = staged(large.union(grouped.join(heavy, "grp", "left_semi").select("fp")).distinct(), "large")
    fine = _compared(large.mapInArrow(ball_copies(max_bits), COPY), max_bits, None)
    return found.where("b is not null").union(fine)


def _compared(copies: DataFrame, max_bits: int, limit: int | None) -> DataFrame:
    dealt = copies.repartition("cell").sortWithinPartitions("cell", "probe")
    return dealt.mapInArrow(compare_cells(max_bits, limit), LINK)


def _rooted(prints: DataFrame, max_bits: int, cell_limit: int) -> DataFrame:
    """``fp``, ``doc`` (its smallest id), ``rows``, ``root`` (of its component) of each distinct fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"))
    distinct = staged(distinct, "distinct")
    roots = components(links(distinct, max_bits, cell_limit))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    return staged(rooted.select("fp", "doc", "rows", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` of every row of ``docs``.

    Texts are read whole, A-Z lower-cased; words lie between space and 9-13;
    shingles of ``width`` words count as often as they occur; a text with fewer
    words is one shingle, a null, empty or blank text has fingerprint zero and
    links like any other.  Fingerprints link at ``max_bits`` or fewer
    differing bits, and ``component_id`` is the smallest id reachable by links.
    Repeated rows give repeated rows.  A row without id takes part; its own id
    stays null, and a component of such rows alone has a null ``component_id``.
    Other columns are ignored.  Only distinct fingerprints are copied and compared.
    """
    prints = staged(fingerprints(texts_of(docs, id_col, text_col), width), "prints")
    rooted = _rooted(prints, max_bits, cell_limit)
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("members"))
    labels = join_skewed(rooted, least, ["root"], "members", ["fp"]).select("fp", "rows", "component_id")
    labels = staged(labels, "labelled")
    return join_skewed(prints, labels, ["fp"], "rows", ["doc_id"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all columns of ``docs``: the one with the smallest id.

    Of rows that share that id and fingerprint one stays; a component without any id
    keeps a row too.  The kept fingerprint and id of each component meet the
    documents by both, so a component of any size is spread.
    """
    prints = staged(fingerprints(texts_of(docs, id_col, text_col), width), "prints")
    rooted = _rooted(prints, max_bits, cell_limit)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "fp")).alias("first"))
    first = first.select("first.fp", F.coalesce("first.doc", F.lit(0)).alias("doc"), "first.none")
    whole = docs.select(
        F.struct("*").alias("row"),
        per_value(F.col(text_col), lambda: lambda text: fingerprint(text, width), "long").alias("fp"),
        F.coalesce(F.col(id_col), F.lit(0)).alias("doc"),
        F.col(id_col).isNull().alias("none"),
    )
    keys = ["fp", "doc", "none"]
    kept = whole.join(first, keys).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    return kept.where("nth = 1").select("row.*")
