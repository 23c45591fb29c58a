import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import bpe, counts, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(4)
    planes = [(32, 127), (0, 32), (127, 1024), (0x2000, 0x2100), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0x1F300, 0x1F6FF), (0x10000, 0x10FFF)]
    made = [None, "", " ", "\n\n  \n", "don't I'LL 's", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext|", "aaaaaaaaaaaaaaaa"]
    made += [chr(c) * 3 + "x " + chr(c) for c in (0x1C, 0x1F, 0x85, 0xA0, 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF, 0xFFFD, 0x7F, 0xAD, 0x301)]
    for _ in range(300):
        chars = []
        for _ in range(rng.randint(1, 40)):
            low, high = rng.choice(planes)
            chars.append(chr(rng.randrange(low, high)))
            if rng.random() < 0.3:
                chars.append(rng.choice([" ", "  ", "'", "the", "ing", "123", "\r\n"]))
        made.append("".join(chars))
    made += ["".join(rng.choice("abcdefghij") for _ in range(20000)), "word " * 30000, " " * 5000, "é" * 3000]
    return made


def test_ids_and_texts_agree_with_the_library(vocabulary, library, monkeypatch):
    for text in texts():
        packed = vocabulary.encode(text)
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, (text or "")[:50]
        assert vocabulary.decode(packed) == library.decode(ids, skip_special_tokens=False) == (text or "")
    monkeypatch.setattr(bpe, "LONG", 10)
    text = "a longer text, cut one by one <|endoftext|> and so on"
    assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_cut_characters_decode_as_the_library_does(vocabulary, library):
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.randrange(256) if rng.random() < 0.7 else rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert vocabulary.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_queues_skip_what_has_changed(vocabulary):
    def plainly(text):
        symbols = [vocabulary.first[b] for b in text]
        while True:
            ranks = [vocabulary.ranks.get(a * vocabulary.base + b, 1 << 30) for a, b in zip(symbols, symbols[1:], strict=False)]
            if min(ranks, default=1 << 30) == 1 << 30:
                return symbols
            at = ranks.index(min(ranks))
            symbols[at : at + 2] = [vocabulary.made[ranks[at]]]

    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abenorst ") for _ in range(rng.randint(1, 30))).encode()
        assert vocabulary.merged(text) == plainly(text)


def test_worker_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    vocabulary.clear()
    for number in range(50):
        vocabulary.encode(f"word{number} {number}")
    assert len(vocabulary) <= 5
    vocabulary.encode("x" * 100)
    assert "x" * 100 not in vocabulary


def rows_of(found):
    return sorted(map(tuple, found.collect()), key=repr)


def test_tables_in_and_out(spark, library):
    rows = [(i, text, "x") for i, text in enumerate(texts())] + [(None, "no id", None), (1, "twice", "y"), (1, "twice", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("n_tokens", F.lit(7))
    tokens = bpe.decoded(bpe.encoded(docs, PATH), PATH)
    assert tokens.columns == ["doc_id", "ids", "text"]
    expected, counted = [], []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (text or "").encode())]
        expected.append((doc_id, len(ids), *digests))
        counted.append((doc_id, len((text or "").encode()), len(ids), len(ids) > 512))
    assert rows_of(queries.bpe_digests(tokens)) == sorted(expected, key=repr)
    assert rows_of(queries.bpe_digests(bpe.round_trip(docs, PATH))) == sorted(expected, key=repr)
    assert rows_of(counts.token_counts(docs, PATH)) == sorted(counted, key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decoded(bpe.encoded(docs, PATH), PATH).count() == bpe.round_trip(docs, PATH).count() == 0
    assert counts.token_counts(docs, PATH).count() == 0


def test_both_tiers_give_the_same_counts(spark, vocabulary, monkeypatch):
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * (i % 5) + f"rare{i}") for i in range(200)], "doc_id long, text string")
    shared = bpe.SharedVocabulary(spark, PATH)
    table = counts.frequent_lengths(docs, shared, share=20).table()
    assert 0 < len(table) < 20 and table[" the"] == 1
    plain = [(i, len(vocabulary.encode("the cat sat on the mat " * (i % 5) + f"rare{i}")) // 4) for i in range(200)]
    for made in (counts.PackedLengths({}), counts.PackedLengths(table)):
        lengths = counts.Lengths(made, vocabulary)
        assert [lengths.count("the cat sat on the mat " * (i % 5) + f"rare{i}") for i, _ in plain] == [n for _, n in plain]


def test_memory_of_frequent_words_does_not_grow_with_their_length():
    import tracemalloc

    import pyarrow as pa

    def batches(length, count):
        rng = random.Random(length)
        for _ in range(count // 100):
            texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(length)) for _ in range(100)]
            yield pa.RecordBatch.from_arrays([pa.array([*texts, "the the and"])], ["text"])

    for length in (1000, 5000):
        tracemalloc.start()
        found = list(counts.frequent_words(1 << 16)(batches(length, 2000)))[0].to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {row["word"]: row["seen"] for row in found} == {None: 2060, "the": 40, "and": 20}
        assert peak < 4 * 100 * (4 * length + 1000) < 2000 * 2 * length * 2


def test_very_long_texts_through_spark(spark, library):
    long = ["many small words " * 70_000, "".join(random.Random(2).choice("abc é日 ") for _ in range(1_100_000))]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    ids = [library.encode(text, add_special_tokens=False).ids for text in long]
    assert [r.n_tokens for r in counts.token_counts(docs, PATH).orderBy("doc_id").collect()] == list(map(len, ids))
    found = bpe.round_trip(docs, PATH).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == ids and [r.text for r in found] == long


def test_other_kinds_of_vocabulary_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file, pytest.raises(ValueError):
        bpe.Vocabulary(file.read())
