"""Folders and files of any number, listed, hashed and read by tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import staged

# Schemes of Spark that the tasks' readers know by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
# What a path shows as it is; anything else would be read as a part of an address.
_PLAIN = "/:@,;=+~!$&'()*-._"
#: Bytes that a task reads of whole files, and at once of a file it goes through.
TASK_BYTES = 128 << 20
CHUNK_BYTES = 8 << 20
#: Names that go back at once from a folder.
NAMES = 10_000
# Folders not listed.
SKIPPED_FOLDERS = (".git", "__pycache__")


def hidden(part: str) -> bool:
    """Whether a folder scan leaves out files below a part of this name."""
    return part in SKIPPED_FOLDERS or (part.startswith(".") and part not in (".", ".."))


def file_system(path: str):
    """The file system of a path and the path in it; raises where no reader of the tasks knows it."""
    from pyarrow import fs

    scheme, _, rest = path.rpartition("://")
    if not scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{quote(rest, safe=_PLAIN)}")


def known_to_tasks(path: str) -> bool:
    try:
        file_system(path)
        return True
    except (OSError, ValueError, NotImplementedError):
        return False


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the requested paths are; a missing one is an error."""
    from pyarrow import fs

    for batch in batches:
        for path in batch["path"]:
            system, inner = file_system(path)
            found = system.get_file_info(inner)
            if found.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            is_folder = found.type == fs.FileType.Directory
            yield pd.DataFrame({"path": [path], "is_folder": [is_folder], "length": [0 if is_folder else found.size]})


def _below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands in folders, without hidden names."""
    from pyarrow import fs

    for batch in batches:
        for folder in batch["path"]:
            system, inner = file_system(folder)
            rows = []
            for found in system.get_file_info(fs.FileSelector(inner)):
                if not hidden(found.base_name):
                    is_folder = found.type == fs.FileType.Directory
                    rows.append((f"{folder.rstrip('/')}/{found.base_name}", is_folder, 0 if is_folder else found.size))
                if len(rows) == NAMES:
                    yield pd.DataFrame(rows, columns=["path", "is_folder", "length"])
                    rows = []
            yield pd.DataFrame(rows, columns=["path", "is_folder", "length"])


def list_files(spark: SparkSession, requested: list[str]) -> DataFrame:
    """``path``, ``length`` of the requested files and of all files below the requested folders.

    Folders are a table: each round's tasks list those that the round before
    has found and write what they see to the shared folder.  No name comes to the driver, only the number of folders
    of each depth.  Links to folders are followed as the file system does.
    """
    schema = "path string, is_folder boolean, length bigint"
    cores = spark.sparkContext.defaultParallelism
    asked = spark.createDataFrame([(path,) for path in requested], "path string")
    level = staged(asked.repartition(min(cores, max(1, len(requested)))).mapInPandas(_asked, schema), "listing")
    files = level.where("not is_folder")
    while number := level.where("is_folder").count():
        folders = level.where("is_folder").select("path").repartition(min(number, 8 * cores))
        level = staged(folders.mapInPandas(_below, schema), "listing")
        files = files.unionByName(level.where("not is_folder"))
    return files.select("path", "length")


def dealt(files: DataFrame) -> DataFrame:
    """Files (``length``) in as many partitions as their bytes ask for, and at least one per core if there are as many."""
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, -(-size.bytes // TASK_BYTES), min(size.n, cores)))


def read_bytes(path: str, start: int, end: int) -> bytes:
    system, inner = file_system(path)
    with system.open_input_file(inner) as file:
        file.seek(start)
        return file.read(end - start)


def whole_contents(files: DataFrame) -> DataFrame:
    """``path``, ``content`` of files (``path``, ``length``), each in one row; null where a file cannot be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                try:
                    content = read_bytes(path, 0, length)
                except OSError:
                    content = None
                yield pd.DataFrame({"path": [path], "content": [content]})

    return dealt(files).select("path", "length").mapInPandas(read, "path string, content binary")


def content_hashes(files: DataFrame) -> DataFrame:
    """``path``, ``sha256`` of files of any length, a chunk in memory at a time; null where a file cannot be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                digest = hashlib.sha256()
                try:
                    system, inner = file_system(path)
                    with system.open_input_file(inner) as file:
                        while chunk := file.read(CHUNK_BYTES):
                            digest.update(chunk)
                    shown = digest.hexdigest()
                except OSError:
                    shown = None
                yield pd.DataFrame({"path": [path], "sha256": [shown]})

    return dealt(files).select("path").mapInPandas(read, "path string, sha256 string")
