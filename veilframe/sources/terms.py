"""Dictionaries: lists of literal terms with an entity type."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.files import passed_over
from veilframe.sources.policies import Policy

TERMS_SCHEMA = "term_ord bigint, term string, entity_type string"
# --- fixed values: first cells that are a header, not a term ----------------
HEADER_WORDS = ("name", "term", "value")


def clean_terms(cells: DataFrame, column: str, entity: str) -> DataFrame:
    """Terms from a column: trimmed, without empty cells and header words."""
    space = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    trimmed = F.regexp_replace(F.regexp_replace(F.col(column), r"^\x{feff}", ""), rf"^[{space}]+|[{space}]+$", "")
    return (
        cells.select(trimmed.alias("term"))
        .where((F.col("term") != "") & ~F.lower("term").isin(*HEADER_WORDS))
        .withColumn("term_ord", F.monotonically_increasing_id())
        .select("term_ord", "term", F.lit(entity).alias("entity_type"))
    )


def read_terms(spark: SparkSession, policy: Policy, base: str | None = None) -> DataFrame | None:
    """All terms of a policy's dictionaries, in listed order; None without any.

    Relative paths are below ``base``.  A list that does not exist is skipped.
    """
    tables = []
    for number, (source, entity) in enumerate(policy.dictionaries):
        path = source if "/" == source[:1] or "://" in source or base is None else f"{base.rstrip('/')}/{source}"
        if passed_over(path.rstrip("/").rsplit("/", 1)[-1]):
            raise ValueError(f"Spark would read nothing from a list of this name: {path}")
        try:
            cells = spark.read.csv(path, schema="_c0 string", header=False, multiLine=True, escape='"', enforceSchema=True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        rows = clean_terms(cells, "_c0", entity)
        tables.append(rows.withColumn("term_ord", F.col("term_ord") + F.lit(number) * F.lit(1 << 56)))
    return reduce(DataFrame.unionByName, tables) if tables else None
