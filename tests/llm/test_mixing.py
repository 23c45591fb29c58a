import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Share, stop at twice the size, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, done, left = 1.5 * sum(sizes.values()), {}, list(names)
    while left:
        level = (budget - sum(done.values())) / sum(weight[s] for s in left)
        above = [s for s in left if level * weight[s] >= 2 * sizes[s]]
        if not above:
            return done | {s: level * weight[s] for s in left}
        done |= {s: 2 * sizes[s] for s in above}
        left = [s for s in left if s not in above]
    return done


def plain_mix(rows):
    """Words taken per row, by one sorted list of packets."""
    sizes, taken, packets = {}, [0] * len(rows), []
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    goals = plain_targets(sizes)
    for number, source in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode()))):
        key = lambda i: hashlib.md5(b"mix:" + str(rows[i][0] if rows[i][0] is not None else "").encode()).hexdigest()[:15]
        own = sorted((i for i, r in enumerate(rows) if r[2] == source), key=lambda i: (key(i), (rows[i][0] is not None, rows[i][0] or 0), size_of(rows[i][1])))
        quantum, at = max(1, math.floor(goals[source] / 1000)), 0
        for _ in range(2):
            for i in own:
                for first in range(0, size_of(rows[i][1]), quantum):
                    words = min(quantum, size_of(rows[i][1]) - first)
                    if at + first < goals[source]:
                        packets.append(((at + first + words) / goals[source], number, at + first, words, i))
                at += size_of(rows[i][1])
    left = math.floor(1.5 * sum(sizes.values()))
    for *_, words, i in sorted(packets):
        taken[i] += min(words, left)
        left -= min(words, left)
    return taken, goals, sizes


def sample(seed=5, number=250):
    rng = random.Random(seed)
    sources = ["a", "B", "é", None, "", "tiny", "hot"]
    rows = []
    for i in range(number):
        source = "hot" if rng.random() < 0.4 else rng.choice(sources)
        words = rng.choice([0, 1, 3, 20, 100]) if source != "tiny" else 2
        rows.append((i, " ".join(["w\x85x"] * words) + rng.choice(["", " ", "\n\t"]), source))
    rows += [(1000, "long " * 5000, "B"), (1001, None, "a"), (1002, None, "nothing"), (None, "no id here", "a")]
    return rows + [(1003, "same row twice", "é")] * 2


def test_targets_are_reshared_until_none_is_above(spark):
    rng = random.Random(2)
    for _ in range(6):
        sizes = {name: rng.choice([0, 1, 10, 500, 10_000]) for name in ["a", "b", "c", "d", "e", None][: rng.randint(1, 6)]}
        found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        expected = plain_targets(sizes)
        assert {r.source: r.source_size for r in found} == sizes
        for row in found:
            assert row.target == pytest.approx(expected[row.source], abs=1e-6)
        assert sum(r.target for r in found) == pytest.approx(1.5 * sum(sizes.values()))


def test_words_taken_agree_with_one_sorted_queue(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x")).withColumn("Target", F.lit(1)).repartition(7)
    found = mixing.mixed(docs)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken", "copies_taken"]
    taken, goals, sizes = plain_mix(rows)
    expected = sorted(((r[0], size_of(r[1]), sizes[r[2]], t) for r, t in zip(rows, taken, strict=True)), key=repr)
    first = sorted(((r.doc_id, r.size, r.source_size, r.taken) for r in found.collect()), key=repr)
    assert first == expected
    again = mixing.mixed(docs.repartition(3)).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, r.taken) for r in again), key=repr) == expected
    by_source = {}
    for (_, _, source), words in zip(rows, taken, strict=True):
        by_source[source] = by_source.get(source, 0) + words
    for source, goal in goals.items():
        assert abs(by_source[source] - goal) <= max(1, goal / 1000) + 1
    assert all(t <= 2 * size_of(r[1]) for r, t in zip(rows, taken, strict=True))


def test_mixture_has_whole_rows_for_each_copy(spark):
    rows = sample(seed=8, number=80)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.col("doc_id")).withColumn("size", F.lit("x"))
    made = mixing.mixture(docs)
    assert made.columns == docs.columns
    taken, _, _ = plain_mix(rows)
    words = {}
    originals = {(r[0], r[1]) for r in rows}
    cut = 0
    for row in made.collect():
        words[row.doc_id] = words.get(row.doc_id, 0) + size_of(row.text)
        assert row.row == row.doc_id
        cut += (row.doc_id, row.text) not in originals
    expected = {}
    for r, t in zip(rows, taken, strict=True):
        if t:
            expected[r[0]] = expected.get(r[0], 0) + t
    assert words == expected and cut <= len({r[2] for r in rows})


def test_no_words_and_no_rows(spark):
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None), (2, "", None)], SCHEMA)
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mixed(blank).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0), (2, 0, 0, 0)]
    assert mixing.mixture(blank).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(empty).count() == 0
