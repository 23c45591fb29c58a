"""Long files in parts: the parts together are what the whole file would be."""

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F
from test_sources import by_id, write

from veilframe.plans.runs import prepare
from veilframe.functions.crypto import vault_key
from veilframe.operators.tokens import empty_vault
from veilframe.sources import listing, ranges
from veilframe.sources.files import read_documents
from veilframe.sources.listing import list_files

PIECES = [b"a", b"bb", b'"', b'""', b",", b"\t", b"\n", b"\r\n", b"\r", b'"q"', b'"x\ny"', b'x"y', b'"a,b"', "é".encode(), b" "]


def random_bytes(rng, count):
    return b"".join(rng.choice(PIECES) for _ in range(count))


def starts_of(content):
    """Where records of lines start, plainly."""
    at, out = 0, [0]
    while at < len(content):
        if content[at : at + 2] == b"\r\n":
            at += 1
        at += 1
        if content[at - 1 : at] in (b"\n", b"\r"):
            out.append(at)
    return out


def test_line_starts():
    rng = random.Random(1)
    for _ in range(300):
        content = random_bytes(rng, rng.randint(0, 30))
        places = [p for p in starts_of(content) if p < len(content)]
        for at in range(len(content) + 2):
            wanted = min((p for p in places if p >= at), default=len(content))
            assert ranges.line_start(io.BytesIO(content), at, len(content), 1 << 20) == wanted


def test_line_starts_over_chunks(monkeypatch):
    monkeypatch.setattr(ranges, "LINE_BYTES", 4)
    content = b"0123456789\r\nabc\rdef\nx" + b"y" * 50
    for at in range(len(content)):
        wanted = min((p for p in starts_of(content) if p >= at and p < len(content)), default=len(content))
        assert ranges.line_start(io.BytesIO(content), at, len(content), 1 << 20) == wanted
    assert ranges.line_start(io.BytesIO(content), 25, len(content), 10) is None


@pytest.fixture()
def split(monkeypatch):
    def to(split_bytes, most=1 << 20):
        monkeypatch.setattr(ranges, "SPLIT_BYTES", split_bytes)
        monkeypatch.setattr(ranges, "MOST_BYTES", most)

    return to


def folder_of(tmp_path, suffix, contents):
    for n, content in enumerate(contents):
        write(tmp_path / f"in/f{n:04d}{suffix}", content)
    return str(tmp_path / "in")


def documents_of(spark, folder):
    """By file: the documents in order of their numbers."""
    out = {}
    for row in read_documents(spark, [folder], folder).collect():
        name, _, number = row["source_id"].partition(":")
        out.setdefault(name, []).append((int(number or 0), row))
    return {name: [row for _, row in sorted(rows, key=lambda r: r[0])] for name, rows in out.items()}


@pytest.mark.parametrize("suffix", [".csv", ".tsv"])
def test_delimited_parts(spark, tmp_path, split, suffix):
    rng = random.Random(len(suffix) + ord(suffix[1]))
    contents = [random_bytes(rng, rng.randint(20, 120)) for _ in range(120)]
    contents += [b"\xef\xbb\xbfa,b\n" + b"c,d\n" * 20, b'"' + b"x\n" * 40 + b'",y\nz\n' * 2, b'a\n"open\n' + b"x,\n" * 30, b"no,end\n" * 9 + b"last"]
    folder = folder_of(tmp_path, suffix, contents)
    whole = documents_of(spark, folder)
    split(16)
    found = documents_of(spark, folder)
    assert set(found) == set(whole)
    cut = 0
    for name, rows in found.items():
        assert "\n".join(row["text"] for row in rows) == whole[name][0]["text"], (name, contents[int(name[1:5])])
        assert {row["sha256"] for row in rows} == {whole[name][0]["sha256"]}
        assert {row["status"] for row in rows} == {"ok"}
        cut += len(rows) > 1
        for row, later in zip(rows, rows[1:], strict=False):
            lines = row["text"].count("\n") + 1
            if '"' not in contents[int(name[1:5])].decode():
                assert int(later["source_id"].split(":")[1]) - int(row["source_id"].split(":")[1]) == lines
    assert cut > 60


@pytest.mark.parametrize("suffix", [".log", ".jsonl"])
def test_parts_of_lines(spark, tmp_path, split, suffix):
    rng = random.Random(9)
    lines = [b"{}", b'{"k": 1}', b"", b"  ", b"[1, 2]", '"é"'.encode(), b"bad"]
    contents = [b"".join(rng.choice(lines) + rng.choice([b"\n", b"\r\n", b"\r"]) for _ in range(30)) + rng.choice([b"", b"7"]) for _ in range(40)]
    contents += ["张三\n".encode("gb18030") * 12 + b"x\n", b"caf\xe9\n" * 12 + b"\x81\n", b"\n \r\n" * 12]
    folder = folder_of(tmp_path, suffix, contents)
    whole = documents_of(spark, folder)
    split(24)
    found = documents_of(spark, folder)
    assert set(found) == set(whole)
    for name, rows in found.items():
        if suffix == ".jsonl":
            fields = ("source_id", "text", "status", "sha256", "error_code")
            assert [[row[f] for f in fields] for row in rows] == [[row[f] for f in fields] for row in whole[name]]
        else:
            assert "".join(row["text"] for row in rows) == whole[name][0]["text"]
            assert len(rows) > 1 and {row["sha256"] for row in rows} == {whole[name][0]["sha256"]}


def test_what_cannot_be_cut_is_an_error(spark, tmp_path, split):
    files = {
        "line.log": b"short\n" * 5 + b"x" * 300 + b"\n", "cell.csv": b"a,b\n" + b'"' + b"y\n" * 150 + b'"\n', "big.json": b"[" + b"1," * 200 + b"1]",
        "latin.csv": b"a,\xe9\n" * 30, "other.bin": b"\0" * 400, "fine.json": b'{"a": "' + b"z" * 100 + b'"}', "small.json": b"[]", "fine.log": b"ok\n" * 60,
    }
    for name, content in files.items():
        write(tmp_path / "in" / name, content)
    split(64, most=200)
    docs = by_id(read_documents(spark, [str(tmp_path / "in")], str(tmp_path / "in")))
    codes = {name: row["error_code"] for name, row in docs.items() if row["error_code"]}
    assert codes == {
        "line.log": "extract_failed", "cell.csv": "extract_failed", "big.json": "extract_failed", "latin.csv": "extract_failed",
        "other.bin": "unknown_format",
    }
    assert all(row["sha256"] == hashlib.sha256(files[name.partition(":")[0]]).hexdigest() for name, row in docs.items())
    assert {name for name in docs if name not in codes} == {"fine.json", "small.json", "fine.log:1", "fine.log:23", "fine.log:44"}
    docs = read_documents(spark, [str(tmp_path / "in")], str(tmp_path / "in"))
    assert prepare(docs, vault_key(spark, b"s" * 32), empty_vault(spark)).blocked


def test_parts_are_read_by_several_tasks(spark, tmp_path, split):
    write(tmp_path / "in/rows.jsonl", b'{"k": 1}\n' * 4000)
    split(1 << 10)
    docs = read_documents(spark, [str(tmp_path / "in")], str(tmp_path / "in"))
    assert docs.count() == 4000
    assert docs.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_listing_goes_round_by_round(spark, tmp_path, monkeypatch):
    wanted = {}
    for n in range(60):
        path = tmp_path / "in" / "/".join(f"d{(n >> k) & 1}" for k in range(n % 5)) / f"f{n}.txt"
        write(path, "x" * n)
        wanted[str(path)] = n
    write(tmp_path / "in/d0/.hidden/x.txt", "no")
    monkeypatch.setattr(listing, "NAMES", 3)
    found = {row.path: row.length for row in list_files(spark, [str(tmp_path / "in")]).collect()}
    assert found == wanted
    assert list_files(spark, [str(tmp_path / "in/d0")]).count() == sum("/in/d0/" in path for path in wanted)
