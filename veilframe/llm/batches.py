"""Small helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import spread


# Results go back when so much text has been read, so that long texts don't pile up in a worker.
RETURNED_CHARS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id``, ``text`` and ``more`` columns alone; other columns, whatever their names, stay out of the way."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)


def per_text(docs: DataFrame, make: Callable[[], Callable[[str | None], tuple]], fields: str) -> DataFrame:
    """One output row per row of ``docs`` (columns ``doc_id`` and ``text``): ``doc_id`` and ``fields``.

    ``make`` runs once in each task and returns the function that is applied to each whole text.
    """
    names = [part.split()[0] for part in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            values, start, chars = [], 0, 0
            for at, text in enumerate(texts):
                text = text.as_py()
                values.append(one(text))
                chars += len(text or "")
                if chars > RETURNED_CHARS or at + 1 == len(texts):
                    arrays = [pa.array(column) for column in zip(*values, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids[start : at + 1], *arrays], ["doc_id", *names])
                    values, start, chars = [], at + 1, 0

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {fields}")


_ARROW_TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}


def per_value(column: Column | str, make: Callable[[], Callable[[str | None], object]], kind: str) -> Column:
    """A column made by a function of the whole text in ``column``, for rows that keep their other columns.

    ``make`` runs once in each task and returns the function.  The optimizer takes the column for non-deterministic,
    so that no filter on it makes it work out each value twice.
    """

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for part in parts:
            yield pa.array((one(text.as_py()) for text in part), _ARROW_TYPES[kind], size=len(part))

    return run.asNondeterministic()(column)
