"""Exact duplicates with a split between frequent and ordinary digests."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.batches import per_value, texts_of
from veilframe.session import staged

#: A digest is frequent when it has more than 1/HOT_SHARE of all rows: a bound for the broadcast.
HOT_SHARE = 1 << 13


def digest(text: str | None) -> bytes:
    """SHA-256 of a whole text, A-Z lower-cased; null counts as empty."""
    return hashlib.sha256((text or "").encode("utf-8", "replace").lower()).digest()


def digests(text: Column | str) -> Column:
    return per_value(text, lambda: digest, "binary")


def merged(counts: Counter, counters: int) -> Counter:
    """At most ``counters`` of ``counts``: the next largest count is taken off all, so that a digest loses no more
    than rows / (counters + 1) over all merges."""
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return Counter({key: n - off for key, n in counts.items() if n > off})


def misra_gries(share: int):
    """Frequent digests of a task (``digest``, ``seen``): counts are too low by at most rows / (2 ``share``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            counts.update(batch.column(0).to_pylist())
            counts = merged(counts, 4 * share - 1)
        found = [(key, n) for key, n in counts.items() if n * 4 * share > rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([key for key, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())],
            ["digest", "seen"],
        )

    return run


def frequent(keyed: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """The winners of frequent digests in ``keyed`` (``digest``, ``doc_id``, ``row_no``): ``digest``, ``keep``, ``group_size``.

    Misra-Gries summaries of all tasks find the candidates, at most 2 ``share``;
    an exact count keeps those with more than 1/``share`` of the rows and
    finds the row that stays.
    """
    rows = keyed.count()
    seen = keyed.select("digest").mapInArrow(misra_gries(share), "digest binary, seen long")
    candidates = seen.groupBy("digest").agg(F.sum("seen").alias("seen")).where(F.col("seen") * 2 * share > rows)
    counted = keyed.join(F.broadcast(staged(candidates.select("digest"), "candidates")), "digest")
    winners = counted.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    return staged(winners.where(F.col("group_size") * share > rows), "winners")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = texts_of(docs, id_col, text_col)
    return staged(texts.select("doc_id", digests("text").alias("digest"), F.monotonically_increasing_id().alias("row_no")), "digests")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = HOT_SHARE
) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null is the empty
    text.  The row with the largest id of a group stays; a null id is smaller
    than any other.  Of rows that share that id one stays, so each group
    keeps exactly one row.  No rows give no rows; other columns are ignored.

    Texts are read once and only digests move.  Rows of frequent digests
    are settled where they are by a broadcast of fewer than ``share`` winners;
    the others are grouped by digest, each with at most 1/``share`` of the rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    winners = F.broadcast(frequent(keyed, share))
    alike = Window.partitionBy("digest")
    rest = (
        keyed.join(winners, "digest", "left_anti")
        .withColumn("keep", F.max(F.struct("doc_id", "row_no")).over(alike))
        .withColumn("group_size", F.count(F.lit(1)).over(alike))
    )
    return (
        keyed.join(winners, "digest")
        .unionByName(rest)
        .select(
            "doc_id",
            F.col("keep.doc_id").alias("keep_id"),
            "group_size",
            (F.col("row_no") == F.col("keep.row_no")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def without_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = HOT_SHARE
) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Rows of frequent digests that do not stay are removed before the shuffle;
    the others meet by digest.
    """
    winners = frequent(_keyed(docs, id_col, text_col), share).select("digest", F.col("keep.doc_id").alias("keep_id"))
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), digests(text_col).alias("digest"))
    left = keyed.join(F.broadcast(winners.withColumn("hot", F.lit(True))), "digest", "left").where(
        F.col("hot").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    )
    latest = Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc_id"))
    return left.withColumn("place", F.row_number().over(latest)).where("place = 1").select("row.*")
