import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import bpe, packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return packing.FastEncoder(bpe.Vocabulary(file.read()))


def piece(number, size):
    return number, 0, np.full(size, number, "<u4")


def squares(counts, window):
    return sum(n * n for level, n in counts.items() if level < window and level & (level - 1))


def test_each_piece_goes_where_the_sum_of_squares_is_least():
    rng, window = random.Random(5), 32
    levels, counts = packing.Levels(window), {}
    for number in range(3000):
        size = rng.choice([3, 5, 7, 11, 13, 17, 20, 31, 8])
        choices = []
        for level in [0, *(x for x, n in counts.items() if n)]:
            if level + size <= window:
                after = dict(counts)
                if level:
                    after[level] -= 1
                after[level + size] = after.get(level + size, 0) + 1
                after.pop(window, None)
                choices.append((squares(after, window), -level, after))
        counts = min(choices, key=lambda c: c[:2])[2]
        closed = list(levels.place(piece(number, size)))
        assert all(sum(len(ids) for _, _, ids in pieces) == window for pieces in closed)
        assert {x: len(w) for x, w in enumerate(levels.open) if w} == {x: n for x, n in counts.items() if n}
        assert levels.number == sum(counts.values())


@pytest.mark.parametrize("most_open", [0, 3, 1000])
def test_closing_cuts_to_fit_and_leaves_powers_of_two(most_open):
    rng, window = random.Random(most_open), 64
    levels, out = packing.Levels(window, most_open), []
    sizes = [rng.choice([40, 41, 50, 63, 1, 33]) for _ in range(500)]
    for number, size in enumerate(sizes):
        out += levels.place(piece(number, size))
        assert levels.number <= most_open
    out += levels.close()
    assert levels.number == 0 and not any(levels.open)
    totals = [sum(len(ids) for _, _, ids in pieces) for pieces in out]
    assert all(total <= window and total & (total - 1) == 0 for total in totals)
    assert sum(total < window for total in totals) <= 6 * (1 if most_open == 1000 else len(sizes))
    seen = {}
    for pieces in out:
        for number, start, ids in pieces:
            assert len(ids) and set(ids.tolist()) == {number}
            seen.setdefault(number, []).append((start, len(ids)))
    for number, size in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[number]):
            assert start == at
            at += length
        assert at == size


def test_ids_equal_the_library(encoder, library):
    from test_bpe import texts

    for text in [*texts(), " " * 300_000 + "x"]:
        assert encoder.encode(text).tolist() == library.encode(text or "", add_special_tokens=False).ids


def check(rows, wanted, window):
    """``wanted``: ids of each document by the value of doc_id, documents that share it in a list."""
    docs, sequences = {}, {}
    for row in rows:
        assert row.length == len(row.ids) // 4 > 0
        docs.setdefault(row.doc_id, []).append(row)
        sequences.setdefault(row.sequence_id, []).append(row)
    for pieces in sequences.values():
        at = 0
        for row in sorted(pieces, key=lambda row: row.offset):
            assert row.offset == at
            at += row.length
        assert at <= window and at & (at - 1) == 0
    assert docs.keys() == wanted.keys()
    for name, pieces in docs.items():
        if len(wanted[name]) == 1:
            pieces.sort(key=lambda row: row.start)
            ids = np.concatenate([np.frombuffer(row.ids, "<u4") for row in pieces]).tolist()
            assert [row.start for row in pieces] == np.cumsum([0, *(row.length for row in pieces)])[:-1].tolist()
            assert ids == wanted[name][0] and {row.doc_tokens for row in pieces} == {len(ids)}
        else:
            assert sum(row.length for row in pieces) == sum(map(len, wanted[name]))


def test_whole_documents_in_sequences(spark, library):
    rng = random.Random(8)
    texts = [None, "", " ", "<|endoftext|>", "é" * 3000, "word " * 30_000, " " * 50_000, "x"]
    texts += [" ".join(rng.choice(["river", "stone", "of", "42", "日本"]) for _ in range(rng.randint(1, 900))) for _ in range(200)]
    rows = [(n, text, 0, 9, 7) for n, text in enumerate(texts)] + [(None, "no id", 0, 9, 7)] + [(900, "twice", 0, 9, 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, sequence_id int, ids int").repartition(3)
    wanted = {}
    for name, text, *_ in rows:
        wanted.setdefault(name, []).append([*library.encode(text or "", add_special_tokens=False).ids, packing.END])
    for most_open in (packing.MOST_OPEN, 2):
        out = packing.packed(docs, PATH, most_open=most_open)
        assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        check(out.collect(), wanted, packing.WINDOW)
    check(packing.packed(docs, PATH, window=16).collect(), wanted, 16)


def test_a_very_long_text_and_text_ids(spark, library):
    text = "so it goes on and on. " * 60_000
    docs = spark.createDataFrame([("a", text), ("b", "short")], "name string, body string")
    rows = packing.packed(docs, PATH, "name", "body").collect()
    wanted = {name: [[*library.encode(one, add_special_tokens=False).ids, 1]] for name, one in (("a", text), ("b", "short"))}
    check(rows, wanted, 2048)


def test_no_rows(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_over_the_given_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    import zlib

    rows = queries.op11_packing(spark, sf).collect()
    ids = {row.doc_id: [*library.encode(row.text or "", add_special_tokens=False).ids, 1] for row in docs.collect()}
    assert {row.doc_id for row in rows} == set(ids)
    for row in rows:
        part = np.array(ids[row.doc_id][row.start : row.start + row.length], "<u4").tobytes()
        assert row.ids_crc32 == zlib.crc32(part) and row.doc_tokens == len(ids[row.doc_id])
    assert sum(row.length for row in rows) == sum(map(len, ids.values()))
    # Few documents are cut that need not be.
    cut = {row.doc_id for row in rows if row.doc_tokens <= 2048 and row.length < row.doc_tokens}
    assert queries.op11_packing(spark, sf).where(F.col("length") == 0).count() == 0 and len(cut) < len(ids) / 2
