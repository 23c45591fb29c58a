"""Documents from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the columns of a document --------------------------------
DOCUMENT_FIELDS = ("source_id", "path", "text", "status", "media_type", "sha256", "error_code", "error_message")


def documents(table: DataFrame, source_id: Column | str, text: Column | str) -> DataFrame:
    """Rows of a table as extracted documents."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    none = F.lit(None).cast("string")
    return table.select(
        as_column(source_id).cast("string").alias("source_id"),
        none.alias("path"),
        F.coalesce(as_column(text), F.lit("")).alias("text"),
        F.lit("ok").alias("status"),
        F.lit("text/plain").alias("media_type"),
        none.alias("sha256"),
        none.alias("error_code"),
        none.alias("error_message"),
    )


def joined_documents(
    table: DataFrame, source_id: str, order: list[str], text: str, between: str = "\n"
) -> DataFrame:
    """Documents made of several rows each, such as the turns of a conversation.

    What begins in one row and ends in another is seen by detection and gate
    only if the rows are one text.  Rows are joined in ``order``, null texts as
    empty ones; ties go by the text.  A document has to fit into one row.
    """
    rows = table.select(
        F.col(source_id).cast("string").alias("source_id"),
        F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_text")).alias("_part"),
    )
    parts = rows.groupBy("source_id").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    return documents(parts, "source_id", F.array_join(F.col("_parts._text"), between))


def repeated_ids(docs: DataFrame) -> DataFrame:
    """Source ids that occur more than once."""
    counts = docs.groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"))
    return counts.where("documents > 1")
