"""Where a run may leave intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a scanned table that one task takes on.
TASK_ROWS = 1 << 15
#: Lets Spark delete the shuffle files of a query when that ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides.  Only a local session without the setting
    gets a folder of its own; on a cluster a machine-local folder would be lost
    with its machine, so the setting is required there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="veilframe-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_STAGED: list[str] = []


def staged(df: DataFrame, label: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder once and read it from there.  ``by``
    names a column with few values whose rows are to be read apart.  ``codec`` is the compression, the session's if none is
    given; Spark takes the size of files for that of rows, so what compresses well and is joined should not be packed tighter.

    Later steps start from the written files: work is not repeated for each
    use, a lost executor costs a re-read only, and columns a step does not need
    are not read.  What was shuffled to write the table is deleted once it is written.
    """
    path = f"{shared_folder(df.sparkSession)}/veilframe-{label}-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    if codec is not None:
        writer = writer.option("compression", codec)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables this process has staged; returns their number.

    Results of earlier runs read from them, so write what is to be kept first.
    """
    dropped = 0
    while _STAGED:
        _delete(spark, _STAGED.pop())
        dropped += 1
    return dropped


@contextmanager
def sensitive(spark: SparkSession) -> Iterator[set[str]]:
    """Labels added to the result name tables, staged inside, that hold raw values or that nothing reads later: they are
    deleted at the end.  Should the block fail, all tables staged inside are."""
    before, labels, done = len(_STAGED), set(), False
    try:
        yield labels
        done = True
    finally:
        mine, _STAGED[before:] = _STAGED[before:], []
        for path in mine:
            label = path.rsplit("/", 1)[1].split("-", 1)[1].rsplit("-", 1)[0]
            if not done or label in labels:
                _delete(spark, path)
            else:
                _STAGED.append(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scanned table to tasks of at most ``TASK_ROWS``, and to all cores at least.

    Detection costs far more than moving such a table, and a scan is cut at the row groups of
    its files: a long file of few row groups keeps few tasks busy, however many partitions its
    scan has, and their share grows with the table.  A table of which no partition holds more than
    twice its share stays as it is.

    For tables straight from a source, whose rows are counted without reading a column:
    counting those of a query with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("held"))
    rows, most = parts.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.max("held"), F.lit(0))).first()
    wanted = max(cores, -(-rows // TASK_ROWS))
    uneven = most * wanted > 2 * rows
    return df.repartition(wanted) if uneven or df.rdd.getNumPartitions() < wanted else df
