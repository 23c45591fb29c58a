"""Joins to a dictionary whose popular keys hold much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts a table is cut into, for each shuffle partition of the session.
PARTS_PER_PARTITION = 4
LEAST_PARTS = 64


def salted_lookup(lookup: DataFrame, keys: list[str], uses: str, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hot keys with their number of parts (``_parts``), and the lookup with a copy for each part (``_salt``).

    A part is to hold at most 1/P of all uses, P being a multiple of the
    session's shuffle partitions: a key with more is split into as many parts as
    its uses need.  Fewer than P keys can have more than 1/P of the uses, which
    bounds the hot keys; all copies together are at most the lookup's rows and 2 P.
    """
    wanted = PARTS_PER_PARTITION * int(lookup.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(LEAST_PARTS, wanted)
    total = counts.agg(F.sum(uses).alias("total")).scalar()
    needed = F.ceil(F.col(uses) * parts / total).cast("int")
    hot = counts.where(F.col(uses) * parts > total).select(*keys, needed.alias("_parts"))
    if uses in lookup.columns:
        copied = lookup.withColumn("_copies", F.greatest(needed, F.lit(1)))
    else:
        copied = lookup.join(F.broadcast(hot), keys, "left").withColumn("_copies", F.coalesce("_parts", F.lit(1))).drop("_parts")
    return hot, copied.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")


def join_skewed(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    uses: str,
    spread_by: list[str],
    counts: DataFrame | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per key) on ``keys``; ``how`` may be ``left`` to keep all rows.

    ``uses`` counts the rows of each key.  Rows of a hot key are dealt to its
    parts by a hash of ``spread_by``, and each part has a copy of the key's
    lookup row.  ``counts`` may give keys and uses from a table that is cheaper to read than the lookup, which
    then needs no ``uses``.
    """
    hot, copies = salted_lookup(lookup, keys, uses, lookup if counts is None else counts)
    salt = F.pmod(F.xxhash64(*spread_by), F.col("_parts")).cast("int")
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt", "_parts")
