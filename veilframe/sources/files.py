"""Files as documents: manifest, content hash, format, text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilframe.functions.delimited import flattened_sql
from veilframe.functions.patterns import sql_string
from veilframe.session import staged
from veilframe.sources import ranges
from veilframe.sources.listing import SKIPPED_FOLDERS, content_hashes, file_system, hidden, known_to_tasks, list_files, whole_contents
from veilframe.sources.tables import DOCUMENT_FIELDS

# --- fixed values: suffixes, media types and error codes --------------------
READERS = {
    ".txt": "text",
    ".md": "text",
    ".markdown": "text",
    ".rst": "text",
    ".log": "text",
    ".csv": "csv",
    ".tsv": "tsv",
    ".json": "json",
    ".jsonl": "jsonl",
}
MEDIA_TYPES = {
    "text": "text/plain",
    "csv": "text/csv",
    "tsv": "text/csv",
    "json": "application/json",
    "jsonl": "application/json",
}
ERROR_MEDIA_TYPE = "application/octet-stream"
SUFFIX_ERRORS = {
    ".docx": "unsupported_format",
    ".xlsx": "unsupported_format",
    ".pptx": "unsupported_format",
    ".doc": "doc_dependency_missing",
    ".pdf": "pdf_dependency_missing",
    ".png": "ocr_dependency_missing",
    ".jpg": "ocr_dependency_missing",
    ".jpeg": "ocr_dependency_missing",
    ".tif": "ocr_dependency_missing",
    ".tiff": "ocr_dependency_missing",
    ".webp": "ocr_dependency_missing",
    ".pages": "unsupported_format",
    ".zip": "unsupported_format",
    ".rar": "unsupported_format",
    ".7z": "unsupported_format",
    ".gz": "unsupported_format",
    ".tar": "unsupported_format",
}
UNKNOWN_FORMAT = "unknown_format"
EXTRACT_FAILED = "extract_failed"
FALLBACK_ENCODINGS = ("gb18030", "latin-1")

MESSAGES = {
    "unsupported_format": "No reader for this format here; provide the document as text, CSV or JSON.",
    "unknown_format": "The file type is not known, so its content cannot be checked.",
    "extract_failed": "The content could not be read as its file type says.",
    "doc_dependency_missing": "Legacy documents need a converter that is not part of this library.",
    "pdf_dependency_missing": "PDF files need a text extractor that is not part of this library.",
    "ocr_dependency_missing": "Images need text recognition that is not part of this library.",
}


def _lookup(mapping: dict[str, str], key: str) -> str:
    pairs = ", ".join(f"{sql_string(name)}, {sql_string(value)}" for name, value in mapping.items())
    return f"element_at(map({pairs}), {key})"


# --- manifest ---------------------------------------------------------------


def _plain_path(path: str) -> str:
    """A path without the scheme of the local file system."""
    return "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path


def _without_nested(paths: list[str]) -> list[str]:
    """Requested paths without repeats and without those that a requested
    folder brings along anyway, so that no file is read twice."""
    kept: list[str] = []
    for path in sorted({_plain_path(path).rstrip("/") or "/" for path in paths}):
        for folder in [one for one in kept if path.startswith(one + "/")]:
            if any(map(hidden, folder.split("/"))):
                kept.remove(folder)  # a folder below a hidden one brings nothing
            elif not any(map(hidden, path.split("/"))):
                break
        else:
            kept.append(path)
    return kept


def listed_folder_path() -> Column:
    """Whether a file found in a folder counts: no part of its path hidden."""
    parts = F.split(F.col("path"), "/")
    return ~F.exists(parts, lambda part: part.isin(*SKIPPED_FOLDERS) | part.rlike(r"^\.(?!\.?$)"))


_FILE_SCHEMA = "path string, content binary"
#: What parts of long files have besides.
PART_FIELDS = {"sha256": "string", "first_no": "bigint", "encoding": "string"}


def passed_over(name: str) -> bool:
    """Whether Spark's file listing drops a file or folder of this name."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


# Bytes copied at once where parts are put together.
COPY_BYTES = 8 << 20
# Folders listed at once.
LISTERS = 32


def overlooked_paths(spark: SparkSession, requested: list[str]) -> list[tuple[str, bool]]:
    """Files that Spark's file sources pass over, and whether they are empty; for file systems that only Spark knows.

    Those sources drop empty files and names that start with ``_`` or ``.``,
    silently and even if such a file is asked for; a check that never sees a file
    must not pass it.  Folders are listed by the cluster's own file systems, many
    at a time; only names come to the driver, and only overlooked ones are kept.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def entries(folder: str) -> list[tuple[str, bool, bool]]:
        path = hadoop.Path(folder)
        listed = path.getFileSystem(conf).listStatus(path)
        return [
            (f"{folder.rstrip('/')}/{status.getPath().getName()}", status.isDirectory(), status.getLen() == 0)
            for status in listed
        ]

    found, folders = [], []
    for asked in requested:
        path = hadoop.Path(asked)
        status = path.getFileSystem(conf).getFileStatus(path)
        if status.isDirectory():
            folders.append((asked, False))
        elif status.getLen() == 0 or passed_over(asked.rsplit("/", 1)[-1]):
            found.append((asked, status.getLen() == 0))
    with ThreadPoolExecutor(LISTERS) as pool:
        while folders:
            deeper = []
            for (_, dropped), listed in zip(folders, pool.map(entries, [folder for folder, _ in folders]), strict=True):
                for path, is_folder, is_empty in listed:
                    name = path.rsplit("/", 1)[-1]
                    if hidden(name):
                        continue
                    if is_folder:
                        deeper.append((path, dropped or passed_over(name)))
                    elif dropped or is_empty or passed_over(name):
                        found.append((path, is_empty))
            folders = deeper
    return found


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The contents of single files; null where the file cannot be opened here."""
    for batch in batches:
        for path, is_empty in zip(batch["path"], batch["is_empty"], strict=True):
            if is_empty:
                yield pd.DataFrame({"path": [path], "content": [b""]})
                continue
            try:
                system, inner = file_system(path)
                with system.open_input_file(inner) as handle:
                    content = handle.read()
            except (OSError, ValueError):
                content = None
            yield pd.DataFrame({"path": [path], "content": [content]})


def _read_by_spark(spark: SparkSession, requested: list[str]) -> DataFrame:
    """``(path, content)`` where only Spark knows the file system.  Files that it would leave out because of their names are
    read one by one, and one that cannot be has null content."""
    plain_path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(requested)
    # Whether or not this version of Spark reads empty files, they come from the list.
    found = seen.where("length > 0").select(plain_path.alias("path"), "content")
    overlooked = overlooked_paths(spark, requested)
    if overlooked:
        few = spark.createDataFrame(overlooked, "path string, is_empty boolean")
        few = few.repartition(min(len(overlooked), 1000))
        found = found.unionByName(few.mapInPandas(_contents, _FILE_SCHEMA))
    return found


def _counted(found: DataFrame, requested: list[str]) -> DataFrame:
    """Files that count: explicitly named ones even below hidden folders (but not below ``.git``), of folders those without
    hidden parts."""
    named = found.sparkSession.createDataFrame([(path, True) for path in requested], "path string, named boolean")
    in_git = F.array_contains(F.split(F.col("path"), "/"), ".git")
    counts = (F.col("named").isNotNull() & ~in_git) | listed_folder_path()
    # As long as the list of paths that the caller gave.
    return found.join(F.broadcast(named), "path", "left").where(counts).drop("named")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, content)`` of files and folders, each file once and whole.  Names that Spark's own sources drop are read too."""
    requested = _without_nested(paths)
    if all(map(known_to_tasks, requested)):
        return whole_contents(_counted(list_files(spark, requested), requested))
    return _counted(_read_by_spark(spark, requested), requested)


def source_id(root: str) -> Column:
    """The path below ``root``, or the bare file name for files elsewhere."""
    folder = _plain_path(root).rstrip("/") + "/"
    below = F.substring(F.col("path"), len(folder) + 1, 1 << 30)
    return F.when(F.col("path").startswith(folder), below).otherwise(F.element_at(F.split(F.col("path"), "/"), -1))


# --- classification ---------------------------------------------------------


def classify(files: DataFrame) -> DataFrame:
    """Add ``reader``, or the ``error_code`` of a file that has none."""
    suffix = r"lower(regexp_extract(path, r'[^/](\.[^./]+)$', 1))"
    return files.selectExpr("*", f"{suffix} as _suffix").selectExpr(
        "* except (_suffix)",
        f"{_lookup(READERS, '_suffix')} as reader",
        f"if({_lookup(READERS, '_suffix')} is null, "
        f"coalesce({_lookup(SUFFIX_ERRORS, '_suffix')}, '{UNKNOWN_FORMAT}'), null) as error_code",
    )


# --- text -------------------------------------------------------------------


@F.pandas_udf(StringType())
def _decode_fallback(contents: pd.Series) -> pd.Series:
    """Text of the rare files that are not UTF-8: first encoding that fits."""

    def decode(content):
        if content is None:
            return None
        for encoding in FALLBACK_ENCODINGS:
            try:
                return bytes(content).decode(encoding)
            except UnicodeDecodeError:
                continue

    return contents.map(decode)


@F.pandas_udf(StringType())
def _canonical_json(texts: pd.Series) -> pd.Series:
    """A JSON text with sorted keys and two-space indent; null if it is not
    exactly one JSON value.  Spark's own parser drops what follows the first
    value and refuses repeated keys, which would hide text from the detectors."""

    def canonical(text):
        try:
            if text is None:
                return None
            shown = json.dumps(json.loads(text), ensure_ascii=False, indent=2, sort_keys=True)
            shown.encode("utf-8")  # half of a surrogate pair is not text
            return shown
        except (ValueError, RecursionError):
            return None

    return texts.map(canonical)


@F.pandas_udf(StringType())
def _decode_part(contents: pd.Series, encodings: pd.Series) -> pd.Series:
    pairs = zip(contents, encodings, strict=True)
    return pd.Series([None if content is None else bytes(content).decode(encoding) for content, encoding in pairs], dtype=object)


def decoded(content: Column) -> Column:
    """UTF-8 where valid (a byte order mark stays), else the fallback.  Only
    contents that are not UTF-8 cross over to Python."""
    text = F.try_validate_utf8(content.cast("string"))
    rest = F.when(text.isNull(), content)
    return F.coalesce(text, _decode_fallback(rest))


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def json_text(text: Column) -> Column:
    return _canonical_json(text)


def delimited_text(text: str, tabs: bool = False) -> Column:
    """Lines of joined cells for a SQL text expression."""
    return F.expr(flattened_sql(text, r"\t" if tabs else ","))


def extract(files: DataFrame, root: str = "/") -> DataFrame:
    """Documents from ``(path, content)``; long files may come in parts, as ``parts_of`` gives them, with their ``sha256``.

    A file that cannot be read becomes a document with an error code and an
    empty text, never a missing row.  Files of JSON lines give one document per
    line that is not blank, ``<source id>:<line number>``; one without such a
    line is a document that could not be read.  Each part of another file is a document, ``<source id>:<number of
    its first line or record>``.
    """
    missing = {name: F.lit(None).cast(kind) for name, kind in PART_FIELDS.items() if name not in files.columns}
    base = classify(files.withColumns(missing) if missing else files).select(
        source_id(root).alias("source_id"), "path", F.coalesce("sha256", F.sha2("content", 256)).alias("sha256"), "content",
        "reader", "error_code", "first_no", "encoding",
    )
    lines_of = F.when(F.col("reader").isin("text", "json", "jsonl"), F.col("content"))
    whole = decoded(F.when(F.col("encoding").isNull(), lines_of))
    other = _decode_part(F.when(F.col("encoding") != "utf-8", lines_of), F.col("encoding"))
    part = F.coalesce(F.when(F.col("encoding") == "utf-8", lines_of).cast("string"), other)
    text = base.withColumn("_text", line_feeds(F.coalesce(whole, part) if "encoding" in files.columns else whole))
    # Delimited files must be UTF-8 (their mark is dropped) and keep line ends in quotes.
    cells = F.regexp_replace(
        F.try_validate_utf8(F.when(F.col("reader").isin("csv", "tsv"), F.col("content")).cast("string")), r"\A\x{feff}", ""
    )
    if "first_no" in files.columns:
        later = F.when(F.col("reader").isin("csv", "tsv") & (F.col("first_no") > 1), F.col("content").cast("string"))
        cells = F.coalesce(later, cells)
    text = text.withColumn("_cells", cells).drop("content")

    # Every file goes the same way: one piece, or for JSON lines a piece per line.
    whole = "array(named_struct('line', {}, 'one', {}))"
    lines = """filter(transform(split(_text, '\\n', -1), (one, n) -> named_struct('line', n + coalesce(first_no, 1L), 'one', one)),
        piece -> trim(piece.one) != '')"""
    # A part may well have no line that is not blank; a file may not.
    pieces = f"""case when reader = 'jsonl' then
            if(coalesce(size(_lines), 0) > 0 or first_no is not null, _lines, {whole.format('cast(null as bigint)', 'cast(null as string)')})
        else {whole.format('first_no', '_text')} end"""
    text = text.withColumn("_lines", F.expr(f"if(reader = 'jsonl', {lines}, null)"))
    read = text.withColumn("_piece", F.explode(F.expr(pieces))).drop("_text", "_lines")
    read = read.withColumn("_text", F.col("_piece.one")).withColumn(
        "source_id", F.expr("if(_piece.line is null, source_id, concat(source_id, ':', _piece.line))")
    )
    read = read.withColumn("_json", json_text(F.when(F.col("reader").isin("json", "jsonl"), F.col("_text")))).withColumn(
        "text",
        F.when(F.col("reader") == "text", F.col("_text"))
        .when(F.col("reader") == "csv", delimited_text("_cells"))
        .when(F.col("reader") == "tsv", delimited_text("_cells", tabs=True))
        .otherwise(F.col("_json")),
    )
    read = read.withColumn(
        "error_code", F.coalesce("error_code", F.when(F.col("text").isNull(), F.lit(EXTRACT_FAILED)))
    )
    failed = F.col("error_code").isNotNull()
    return read.select(
        "source_id",
        "path",
        F.when(failed, "").otherwise(F.col("text")).alias("text"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, ERROR_MEDIA_TYPE).otherwise(F.expr(_lookup(MEDIA_TYPES, "reader"))).alias("media_type"),
        "sha256",
        "error_code",
        F.expr(f"if(error_code is null, null, {_lookup(MESSAGES, 'error_code')})").alias("error_message"),
    ).select(*DOCUMENT_FIELDS)


def read_documents(
    spark: SparkSession, paths: list[str], root: str, split: int | None = None, most: int | None = None
) -> DataFrame:
    """Documents from files and folders.

    Files longer than ``split`` bytes (``ranges.SPLIT_BYTES``) that consist of lines or records are read by many
    tasks, part by part.  Others are read whole up to ``most`` (``ranges.MOST_BYTES``); what is longer becomes a document with an error code.
    """
    split, most = split or ranges.SPLIT_BYTES, most or ranges.MOST_BYTES
    requested = _without_nested(paths)
    if not all(map(known_to_tasks, requested)):
        return extract(_counted(_read_by_spark(spark, requested), requested), root)
    listed = staged(classify(_counted(list_files(spark, requested), requested)), "files")
    long = listed.where(F.col("length") > split)
    short = whole_contents(listed.where(F.col("length") <= split))
    if long.isEmpty():
        return extract(short, root)
    cut = ranges.parts_of(long.where(F.col("reader").isin(*ranges.RECORDS)), split, most)
    other = long.where(~F.coalesce(F.col("reader").isin(*ranges.RECORDS), F.lit(False)))
    readable = F.coalesce(F.col("reader") == "json", F.lit(False)) & (F.col("length") <= most)
    whole = whole_contents(other.where(readable)).unionByName(other.where(~readable).select("path", F.lit(None).cast("binary").alias("content")))
    # A row per long file, and every part of a file has the same key: a shuffle would bring them all to one task.
    hashes = F.broadcast(content_hashes(long))
    fields = [F.lit(None).cast(kind).alias(name) for name, kind in PART_FIELDS.items()]
    pieces = cut.unionByName(whole.select("*", *fields[1:])).join(hashes, "path")
    return extract(short.select("*", *fields).unionByName(pieces), root)


def write_contents(files: DataFrame, encoding: str = "utf-8") -> None:
    """Write each ``text`` to its ``path``, by tasks; a task that is run again writes the same files again."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                system, inner = file_system(_plain_path(path))
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(text.encode(encoding))
            yield pd.DataFrame({"written": [len(batch)]})

    files.select("path", "text").mapInPandas(write, "written bigint").agg(F.sum("written")).first()


def write_named(lines: DataFrame, path: str) -> None:
    """Write lines (one text column, in order) as one file of this name.

    Tasks work the lines out and write them part by part; one task puts the parts' bytes together, where tasks know
    the file system.
    """
    folder, name = path.rsplit("/", 1)
    parts = f"{folder}/_written"
    joined = known_to_tasks(parts)
    (lines if joined else lines.coalesce(1)).write.text(parts, lineSep="\n")
    spark = lines.sparkSession
    source = spark._jvm.org.apache.hadoop.fs.Path(parts)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = sorted(status.getPath().getName() for status in system.listStatus(source))
    listed = [one for one in listed if one.startswith("part-")]
    if joined:
        _put_together(spark, [f"{parts}/{one}" for one in listed], path)
    else:
        for one in listed:
            system.rename(spark._jvm.org.apache.hadoop.fs.Path(source, one), spark._jvm.org.apache.hadoop.fs.Path(path))
    system.delete(source, True)


def _put_together(spark: SparkSession, parts: list[str], path: str) -> None:
    """One file of the bytes of others, in this order."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ordered, target in zip(batch["parts"], batch["path"], strict=True):
                system, inner = file_system(_plain_path(target))
                with system.open_output_stream(inner) as out:
                    for one in ordered:
                        with system.open_input_file(file_system(_plain_path(one))[1]) as part:
                            while chunk := part.read(COPY_BYTES):
                                out.write(chunk)
            yield pd.DataFrame({"written": [len(batch)]})

    whole = spark.createDataFrame([(parts, path)], "parts array<string>, path string").coalesce(1)
    whole.mapInPandas(put, "written bigint").agg(F.sum("written")).first()
