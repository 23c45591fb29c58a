import random
import zlib

import pytest
from pyspark.sql import functions as F

from veilframe.llm import language
from veilframe.llm.batches import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    return language.languages(table(spark, SF, "documents")).collect()


def test_held_out_texts_are_told_apart(spark, found):
    truth = {r.doc_id: (r.lang, r.text) for r in table(spark, SF, "documents").collect()}
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out and len(truth[r.doc_id][1]) > 100]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.rejected for r in found) <= 0.01 * len(found)


def test_only_texts_decide(spark, found):
    docs = table(spark, SF, "documents")
    model = language.learned(docs)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).withColumn("margin", F.lit(1)).withColumn("doc_id", F.col("doc_id") + 10**6)
    again = language.languages(other, model=model).collect()
    assert {r.doc_id - 10**6: (r.lang_pred, r.score) for r in again} == {r.doc_id: (r.lang_pred, r.score) for r in found}


def test_learning_leaves_out_the_held_out_fold(spark):
    rows = [(i, f"wort{i} haus baum garten und noch mehr davon", "de" if zlib.crc32(str(i).encode()) % 3 != 1 else "secret") for i in range(200)]
    model = language.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["de"] and b"wort" in model.contents[0]


def test_passages_are_bounded(spark):
    rows = [(i, "x" * 5000, "a") for i in range(500)] + [(i + 500, "y" * 10, "b") for i in range(20)]
    model = language.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), passages=10)
    assert model.names == ["a", "b"]
    assert len(model.contents[0]) == 10 * language.PASSAGE_CHARS + 9


def test_every_language_is_learned(spark):
    def words(lang, seed):
        rng, own = random.Random(seed), random.Random(f"words of {lang}")
        known = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        return " ".join(rng.choice(known) for _ in range(40))

    rows = [(150 * nth + lang, words(lang, nth), f"l{lang}") for lang in range(150) for nth in range(9 if lang < 140 else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.learned(docs).names) == 150
    found = {r.doc_id: r for r in language.languages(docs).collect()}
    assert all(found[doc_id].lang_pred == lang and not found[doc_id].rejected for doc_id, _, lang in rows)


def test_passages_of_many_languages_are_shared(monkeypatch):
    assert language.share([5, 10**6, 700], 600) == 600
    assert language.share([], 600) == 600
    monkeypatch.setattr(language, "ALL_PASSAGES", 100)
    assert language.share([2, 3, 500, 400], 600) == 47
    assert language.share([2, 3, 500, 400], 10) == 10
    assert language.share([9] * 300, 600) == 1


def test_odd_rows(spark):
    base = [(r.doc_id, r.text, r.lang) for r in table(spark, SF, "documents").collect()]
    numbers = [(10**7 + 10 + n, text, "en") for n, text in enumerate(["½ ² Ⅷ ①", "²³ ١٢", "㊀ 〇 ৪", "_ _1", "\u0301 \u0bcd"])]
    odd = [*numbers, (10**7, None, "en"), (10**7 + 1, "", "en"), (10**7 + 2, "123 !!", "en"), (None, base[0][1], None), (10**7 + 3, base[0][1] * 300, None), base[5], base[5]]
    docs = spark.createDataFrame(base + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language.languages(docs).collect()
    assert len(got) == len(base) + len(odd)
    by = {r.doc_id: r for r in got}
    for doc_id in (10**7, 10**7 + 1, 10**7 + 2, *(doc_id for doc_id, _, _ in numbers)):
        assert (by[doc_id].lang_pred, by[doc_id].score, by[doc_id].rejected) == ("und", 0.0, True)
    assert by[None].held_out is False
    assert by[10**7 + 3].lang_pred == by[None].lang_pred == by[base[0][0]].lang_pred
    assert language.languages(docs.limit(0)).count() == 0
    unlabelled = language.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.rejected) for r in unlabelled.collect()} == {("und", True)}


def test_narrow_margins_are_rejected():
    model = language.Languages({"a": ["the quick brown fox jumps over the lazy dog " * 5], "b": ["der schnelle braune fuchs springt " * 5]})
    compressors = model.compressors()
    assert model.classify("the quick brown fox jumps over the lazy dog again and again", compressors)[0] == "a"
    name, margin, rejected = model.classify("zzqx vvwk " * 20, compressors)
    assert rejected and margin < language.NARROW
    assert model.classify("zq", compressors)[2] is False


def test_letters_are_what_the_character_database_calls_so():
    import unicodedata

    kept = language.letters("".join(f"{chr(c)} " for c in range(0x3400) if unicodedata.category(chr(c)) != "Cn")).decode().split()
    known = [chr(c).lower() for c in range(0x3400) if unicodedata.category(chr(c)).startswith("L")]
    assert "".join(kept) == "".join("".join(c for c in one if c.isalpha()) for one in known)
    assert language.letters("a½b Ⅷ²c") == b"a b c"


def plain_run(rows):
    """The whole query in plain Python: {doc_id: (held_out, lang_pred, score)}."""
    import struct

    import xxhash
    import zstandard

    def words(text):
        return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()

    known = {}
    for doc_id, text, lang in rows:
        if lang is not None and text and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            place = struct.unpack("<q", xxhash.xxh64(struct.pack("<q", doc_id), seed=42).digest()[::-1])[0] % (1 << 30)
            start = max(0, min(len(text) // 3, len(text) - 400))
            known.setdefault(lang, []).append((place, doc_id, text[start : start + 400]))
    coders = []
    for lang in sorted(known, key=lambda lang: (-len(known[lang]), lang)):
        content = b" ".join(" ".join(words(text)).encode() for _, _, text in sorted(known[lang])[:600])
        content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=6, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)
        coders.append((lang, coder))
    out = {}
    for doc_id, text, _ in rows:
        raw = " ".join(words(text)).encode()
        sizes = [(sum(len(coder.compress(raw[at : at + 1024])) for at in range(0, len(raw), 1024)), n) for n, (_, coder) in enumerate(coders)]
        best = sorted(sizes)[:2]
        found = ("und", 0.0) if not raw else (coders[best[0][1]][0], min(1.0, 4 * (1 - best[0][0] / best[1][0])))
        out[doc_id] = (zlib.crc32(str(doc_id).encode()) % 3 == 1, *found)
    return out


def test_whole_query_equals_a_plain_run(spark):
    from veilframe.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, sf, "documents").collect()]
    wanted = plain_run(rows)
    for row in queries.op7_language(spark, sf).collect():
        held, lang, score = wanted[row.doc_id]
        assert (row.held_out, row.lang_pred) == (held, lang) and abs(row.score - score) < 1e-12
