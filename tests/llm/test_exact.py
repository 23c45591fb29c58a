import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.llm import exact


def normal(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sample():
    rng = random.Random(3)
    words = [None, "", "Same", "same", "É", "é", "x" * 200_000, " same", "Other"]
    rows = [(i, rng.choice(words[2:]) if i % 3 else "hot TEXT", i) for i in range(300)]
    rows += [(1000 + i, f"single {i}", i) for i in range(50)] + [(2000, None, 1), (2001, "", 1), (None, "only me", 1), (None, "same", 1)]
    rows += [(3000, "again", 1)] * 3 + [(None, "nobody", 1)] * 2
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [4, 1 << 13])
def test_every_group_keeps_its_last_row(spark, share):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep long").withColumn("Digest", F.lit("x")).repartition(6)
    found = exact.exact_duplicates(docs, share=share).collect()
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    last = {text: max((x for x in ids if x is not None), default=None) for text, ids in groups.items()}
    expected = Counter((d, last[normal(t)], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for d, t, _ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    kept = [r for r in found if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("share", [4, 1 << 13])
def test_kept_rows_come_whole(spark, share):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep long").withColumn("Digest", F.lit("x")).repartition(6)
    kept = exact.without_duplicates(docs, share=share)
    assert kept.columns == docs.columns
    last = {}
    for doc_id, text, _ in rows:
        last[normal(text)] = max((x for x in (last.get(normal(text)), doc_id) if x is not None), default=None)
    assert Counter((r.doc_id, normal(r.text)) for r in kept.collect()) == Counter((d, t) for t, d in last.items())


def test_summaries_never_miss_a_frequent_digest():
    rng = random.Random(1)
    values = [b"a"] * 400 + [b"b"] * 210 + [b"%d" % rng.randrange(10**9) for _ in range(1000)]
    rng.shuffle(values)
    counts = Counter()
    for start in range(0, len(values), 37):
        counts.update(values[start : start + 37])
        counts = exact.merged(counts, 19)
        assert len(counts) <= 19
    for key, true in ((b"a", 400), (b"b", 210)):
        assert true - len(values) / 20 <= counts[key] <= true


def test_frequent_digests_are_exact(spark):
    rows = [(i, bytes([i % 7 if i % 2 else 9]), i) for i in range(1000)]
    keyed = spark.createDataFrame(rows, "doc_id long, digest binary, row_no long").repartition(9)
    found = {bytes(r.digest): (r.keep.doc_id, r.group_size) for r in exact.frequent(keyed, 10).collect()}
    assert found == {b"\t": (998, 500)}


def test_nothing_in_gives_nothing_out(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_duplicates(docs).count() == 0
    assert exact.without_duplicates(docs).count() == 0
