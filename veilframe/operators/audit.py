"""Audit tables and their sinks.  None of them holds a raw value."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.detect import SPANS
from veilframe.operators.gate import BUNDLE_HEADER, section

REPORT_FIELDS = ("entity_type", "action", "source_id", "start", "end", "confidence", "detector", "risk", "locator")


def report_findings(found: DataFrame) -> DataFrame:
    """The public view of findings: everything but the value."""
    locator = F.struct(F.lit("text").alias("kind"), F.col("start"), F.col("end"))
    return found.withColumn("confidence", F.round("confidence", 3)).withColumn("locator", locator).select(*REPORT_FIELDS)


def counts_by_entity(found: DataFrame) -> DataFrame:
    return found.groupBy("entity_type").agg(F.count(F.lit(1)).alias("findings"))


def counts_by_action(found: DataFrame) -> DataFrame:
    return found.groupBy("action").agg(F.count(F.lit(1)).alias("findings"))


def counts_grouped(found: DataFrame) -> DataFrame:
    """Counts by entity type, by action and in all, from one pass."""
    return found.groupingSets(
        [[F.col("entity_type")], [F.col("action")], []], F.col("entity_type"), F.col("action")
    ).agg(F.count(F.lit(1)).alias("findings"))


def findings_per_document(detected: DataFrame) -> DataFrame:
    """Number of findings of every document, zero included.

    The spans are an array in the document's row, so this needs no join.
    """
    return detected.select("source_id", F.size(SPANS).cast("bigint").alias("finding_count"))


def document_results(detected: DataFrame, status: str, output_name: Column | None = None) -> DataFrame:
    """Outcome per document: ``status`` or ``error``, output name and counts."""
    failed = F.col("status") == "error"
    name = output_name if output_name is not None else F.lit(None).cast("string")
    return detected.select(
        "source_id",
        F.when(failed, "error").otherwise(status).alias("status"),
        F.when(~failed, name).alias("output_path"),
        F.when(failed, 0).otherwise(F.size(SPANS)).cast("bigint").alias("finding_count"),
        "error_code",
        "error_message",
    )


def summary(found: DataFrame, run_id: str, blocked: bool) -> DataFrame:
    """One row for the run: verdict, number of findings, counts as maps."""
    counts = counts_grouped(found)

    def as_map(name: str, other: str) -> Column:
        entries = F.when(F.col(name).isNotNull() & F.col(other).isNull(), F.struct(name, "findings"))
        return F.map_from_entries(F.array_sort(F.collect_list(entries)))

    total = F.max(F.when(F.col("entity_type").isNull() & F.col("action").isNull(), F.col("findings")))
    return counts.agg(
        F.lit(run_id).alias("run_id"),
        F.lit(blocked).alias("blocked"),
        F.coalesce(total, F.lit(0)).alias("finding_count"),
        as_map("entity_type", "action").alias("counts_by_entity"),
        as_map("action", "entity_type").alias("counts_by_action"),
    )


def output_name(source_id: Column) -> Column:
    """A file-safe name: anything but letters, numbers and ``.-_`` becomes ``_``."""
    return F.concat(F.regexp_replace(source_id, r"[^\p{L}\p{N}._-]", "_"), F.lit(".redacted.md"))


def checked_run_id(run_id: str) -> str:
    """A run id that can name a folder."""
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"not a name for a folder: {run_id!r}")
    return run_id


def write_documents(sanitized: DataFrame, path: str, run_id: str) -> None:
    """One row per sanitized document, under the run's partition, which must not exist."""
    named = sanitized.select("source_id", output_name(F.col("source_id")).alias("output_name"), "text")
    named.write.mode("error").parquet(f"{path}/run_id={run_id}")


def bundle_sections(sanitized: DataFrame) -> DataFrame:
    """Sections in bundle order: sorted by source id across the partitions."""
    return sanitized.select("source_id", section().alias("section")).orderBy("source_id")


def write_bundle(sanitized: DataFrame, path: str) -> None:
    """The bundle as text files whose names sort in bundle order.

    Joined with line feeds they are one text: header, then every section.  Each
    task writes its own range, so no task ever holds the whole bundle.
    """
    spark = sanitized.sparkSession
    header = spark.createDataFrame([(f"{BUNDLE_HEADER}\n",)], "section string")
    header.coalesce(1).write.text(f"{path}/part=0-header")
    bundle_sections(sanitized).select("section").write.text(f"{path}/part=1-sections")


def write_report(path: str, run_id: str, tables: dict[str, DataFrame]) -> None:
    """The audit tables as JSON lines, one folder per table."""
    for name, table in tables.items():
        table.write.mode("error").json(f"{path}/{run_id}/{name}", ignoreNullFields=False)
