"""Long files cut into parts at the ends of records, found by many tasks at once.

A file is cut into byte ranges.  Each task moves the ends of its range to line
starts and says what it holds: lines, encodings that fit, and for delimited
files where the first record starts and whether a quoted cell is open at the end,
for either case at its start.  Folding these, range by range, tells the cases apart
and gives parts that start and end with a record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.listing import file_system

#: Longer files are cut into ranges of this many bytes.
SPLIT_BYTES = 64 << 20
#: What one part, or a file that can't be cut, may have at most.
MOST_BYTES = 1 << 30
#: Bytes looked at in one go for the end of a line.
LINE_BYTES = 1 << 20

#: Bytes a task reads at least where there are more ranges than cores, and the most tasks.
TASK_BYTES = 4 << 20
MOST_TASKS = 1 << 15

RECORDS = {"text": b"", "jsonl": b"", "csv": b",", "tsv": b"\t"}
_LINE_END = re.compile(rb"\r\n?|\n")


def line_start(file, at: int, length: int, most: int) -> int | None:
    """The first start of a line at or behind ``at``; the file's length if there is none, None if it is too far off."""
    if at <= 0 or at >= length:
        return min(max(at, 0), length)
    place = at - 1
    file.seek(place)
    while place < length:
        if place - at > most:
            return None
        chunk = file.read(min(LINE_BYTES, length - place))
        found = _LINE_END.search(chunk)
        # A carriage return at the very end may go with the line feed behind it.
        if found and not (found.end() == len(chunk) and chunk.endswith(b"\r")):
            return place + found.end()
        if found:
            after = file.read(1)
            return place + found.end() + (after == b"\n")
        place += len(chunk)
    return length


def _cells(separator: bytes) -> tuple[re.Pattern, re.Pattern]:
    """A record that starts here, with its end; and what is left of one whose quoted cell is open here."""
    rest = rb"[^" + separator + rb"\r\n]*+"
    quoted = rb'"(?:[^"]++|"")*+(?:"' + rest + rb")?+"
    plain = rb'(?:[^"' + separator + rb"\r\n]" + rest + rb")?+"
    cell = rb"(?:" + quoted + rb"|" + plain + rb")"
    more = rb"(?:" + separator + cell + rb")*+"
    end = rb"(?:\r\n?|\n)"
    return re.compile(cell + more + end), re.compile(rb'(?:[^"]++|"")*+"' + rest + more + end)


def records(content: bytes, separator: bytes, is_open: bool) -> tuple[int, int, bool]:
    """Of a range: where the first record starts (-1: nowhere), how many records end in it, and whether a quoted cell is
    open at its end."""
    record, remainder = _cells(separator)
    at, first, ended = 0, 0, 0
    if is_open:
        found = remainder.match(content)
        if found is None:
            # Either a cell stays open, or it is the last record, which has no end.
            closed = re.match(rb'(?:[^"]++|"")*+"[^' + separator + rb"\r\n]*+", content)
            after = closed and closed.end()
            return -1, 0, closed is None or (content[after : after + 1] == separator and _left_open(content[after + 1 :], separator))
        at = first = found.end()
        ended = 1
    while at < len(content):
        found = record.match(content, at)
        if found is None:
            return first, ended, _left_open(content[at:], separator)
        at, ended = found.end(), ended + 1
    return (first if first < len(content) else -1), ended, False


def _left_open(content: bytes, separator: bytes) -> bool:
    """Whether a record without an end has a quoted cell open; a range's end stands behind a line end, so only there it can be."""
    rest = rb"[^" + separator + rb"\r\n]*+"
    done = rb'(?:"(?:[^"]++|"")*+"' + rest + rb'|(?:[^"' + separator + rb"\r\n]" + rest + rb")?+)"
    before = rb"(?:" + done + separator + rb")*+"
    return re.match(before + rb'"(?:[^"]++|"")*+\Z', content) is not None


def _fits(content: bytes, encoding: str) -> bool:
    try:
        content.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


_LOOKED = (
    "path string, reader string, at bigint, start bigint, end bigint, lines bigint, filled boolean, utf8 boolean, gb18030 boolean, "
    "firsts array<bigint>, ends array<bigint>, opens array<boolean>, too_long boolean"
)
_PARTS = "path string, start bigint, end bigint, first_no bigint, encoding string, failed boolean"


def _looked(split: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, reader, at, length in zip(batch["path"], batch["reader"], batch["at"], batch["length"], strict=True):
                row = {
                    "path": path, "reader": reader, "at": at, "start": at, "end": at, "lines": 0, "filled": False, "utf8": True,
                    "gb18030": True, "firsts": [-1, -1], "ends": [0, 0], "opens": [False, True], "too_long": False,
                }
                try:
                    system, inner = file_system(path)
                    with system.open_input_file(inner) as file:
                        start = line_start(file, at, length, most)
                        end = line_start(file, min(at + split, length), length, most)
                        if start is None or end is None or end - start > most:
                            row["too_long"] = True
                        elif start < end:
                            file.seek(start)
                            content = file.read(end - start)
                            row |= {"start": start, "end": end, "utf8": _fits(content, "utf-8")}
                            separator = RECORDS[reader]
                            if separator:
                                found = [records(content, separator, is_open) for is_open in (False, True)]
                                row |= {
                                    "firsts": [start + one[0] if one[0] >= 0 else -1 for one in found],
                                    "ends": [one[1] for one in found], "opens": [one[2] for one in found],
                                }
                            else:
                                lines = len(_LINE_END.findall(content))
                                filled = reader == "jsonl" and re.search(rb"[^ \r\n]", content) is not None
                                row |= {"firsts": [start, start], "lines": lines, "filled": filled, "gb18030": _fits(content, "gb18030")}
                except OSError:
                    row["too_long"] = True
                yield pd.DataFrame({name: [value] for name, value in row.items()})

    return run


def _folded(most: int):
    def run(ranges: pd.DataFrame) -> pd.DataFrame:
        """Parts of a file from its ranges."""
        ranges = ranges.sort_values("at")
        path, reader = ranges["path"].iloc[0], ranges["reader"].iloc[0]
        parts, number, is_open, last = [], 1, False, int(ranges["end"].max())
        for row in ranges.itertuples():
            if row.start >= row.end:
                continue
            case = int(is_open)
            if RECORDS[reader]:
                if row.firsts[case] >= 0:
                    parts.append((int(row.firsts[case]), number + case))
                number += int(row.ends[case])
                is_open = bool(row.opens[case])
            else:
                parts.append((int(row.start), number))
                number += int(row.lines)
        starts = [start for start, _ in parts]
        failed = bool(ranges["too_long"].any()) or any(end - start > most for start, end in zip(starts, [*starts[1:], last], strict=True))
        failed |= not parts or (reader == "jsonl" and not ranges["filled"].any())
        encoding = "utf-8" if ranges["utf8"].all() else "gb18030" if ranges["gb18030"].all() else "latin-1"
        failed |= bool(RECORDS[reader]) and encoding != "utf-8"
        if failed:
            return pd.DataFrame({"path": [path], "start": [0], "end": [0], "first_no": [None], "encoding": [None], "failed": [True]})
        return pd.DataFrame(
            {
                "path": path, "start": starts, "end": [*starts[1:], last], "first_no": [no for _, no in parts],
                "encoding": encoding, "failed": False,
            }
        )

    return run


def _tasks(number: int, size: int, cores: int) -> int:
    """Tasks for so many ranges: one each, but small ranges go together until a task has TASK_BYTES or all cores have work."""
    return max(1, min(number, max(4 * cores, size // TASK_BYTES), MOST_TASKS))


def parts_of(files: DataFrame, split: int | None = None, most: int | None = None) -> DataFrame:
    """``path``, ``content``, ``first_no``, ``encoding`` of the parts of long files (``path``, ``reader``, ``length``).

    ``first_no`` is the number of a part's first line or record, from 1 on.  A
    file whose parts can't be told, because a line or record is longer than ``most``
    bytes or because it is delimited and not UTF-8, or that can't be read, has one row with null content and
    number.  A file of JSON lines without any is such a file, too.
    """
    split, most = split or SPLIT_BYTES, most or MOST_BYTES
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1), F.lit(split).cast("long")))
    ranges = files.select("path", "reader", "length", at.alias("at"))
    sizes = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / split)), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = _tasks(int(sizes.n), int(sizes.bytes), files.sparkSession.sparkContext.defaultParallelism)
    ranges = ranges.repartition(tasks)
    looked = ranges.mapInPandas(_looked(split, most), _LOOKED)
    # One row per range: a file of ten terabytes has 160,000.
    parts = looked.groupBy("path").applyInPandas(_folded(most), _PARTS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                content = None
                if not row.failed:
                    system, inner = file_system(row.path)
                    with system.open_input_file(inner) as file:
                        file.seek(row.start)
                        content = file.read(row.end - row.start)
                number = None if row.failed else int(row.first_no)
                yield pd.DataFrame({"path": [row.path], "content": [content], "first_no": [number], "encoding": [row.encoding]})

    dealt = parts.repartition(tasks)
    return dealt.mapInPandas(read, "path string, content binary, first_no bigint, encoding string")
