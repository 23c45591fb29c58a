import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import queries, topk

SCHEMA = "vec_id long, embedding array<double>"


def vectors(number, dims, seed, spread=0.2):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dims)]) for i in range(number)]


@pytest.mark.parametrize("slices", [1, 3, 5, 12])
@pytest.mark.parametrize("number", [1, 2, 63, 64, 65, 500])
def test_blocks_find_the_best(number, slices):
    rng = np.random.default_rng(number)
    rows = rng.integers(-300, 300, (number, 9)).astype(np.int64)
    rows[number // 2 :] = rows[: number - number // 2]
    ids = np.arange(number)[::-1].copy()
    block = topk.SlicedBlock(rows, slices)
    for query in [*rows[:4], np.zeros(9, np.int64), rng.integers(-5, 5, 9), -rows[0]]:
        for own in (ids[0], -1):
            found, scores = block.best(query, 5, ids, own)
            best = sorted((-int(row @ query), int(i)) for row, i in zip(rows, ids, strict=True) if i != own)[:5]
            assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == best


def test_bitmap_sums_are_sums():
    rng = np.random.default_rng(3)
    rows = rng.integers(-100, 100, (130, 7)).astype(np.int64)
    block = topk.SlicedBlock(rows, 12)
    query = rng.integers(-20, 20, 7)
    slices = block.sums(query)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(int) for s in slices]
    total = sum(b << i for i, b in enumerate(bits))
    top = (1 << block.bits) - 1
    assert (total == (np.where(query < 0, top - (rows - block.least), rows - block.least) * np.abs(query)).sum(axis=1)).all()


@pytest.mark.parametrize("block_rows", [1 << 13, 40])
def test_search_agrees_with_all_pairs(spark, block_rows, monkeypatch):
    if block_rows == 40:
        monkeypatch.setattr(topk, "BLOCK_BYTES", 2 * topk.SLICES * 8 * 70)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = vectors(400, 8, 1) + vectors(60, 3, 2)[1:]
    rows = [(i if len(v) == 8 else 1000 + i, v) for i, v in rows]
    rows += [(None, [0.1] * 8), (2000, None), (2050, [0.1, None] + [0.2] * 6), (2100, [math.nan] * 8), (2150, [math.inf] * 8)]
    rows += [(2200, [1e30] * 8), (2250, []), (2251, []), (2300, [1.0]), (3000, [5000.25] * 8), (3050, [-0.001] * 8), (3100, [0.0] * 8)]
    rows += [(3200 + i, rows[7][1]) for i in range(6)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(1)).withColumn("Score", F.lit("x")).repartition(4)
    got = topk.top_k(table, block_rows=block_rows).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.query_id, r.rank, r.vec_id, r.whole_score) for r in got) == wholly(rows)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0])]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    once = [(50, 1, 1, 32768, "32768"), (50, 2, 1, 32768, "32768"), (50, 3, 2, 16384, "16384")]
    assert sorted(map(tuple, found)) == sorted(once * 2)
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.top_k(spark.createDataFrame([(50, [1.0])], SCHEMA)).count() == 0


def wholly(rows, every=50, wanted=5):
    """All pairs in fractions, without a range."""
    def fits(row):
        return row[0] is not None and row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])

    used = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in filter(fits, rows)]
    out = []
    for q, a in used:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in used if i != q and len(b) == len(a))
            out += [(q, rank + 1, i, str(-s)) for rank, (s, i) in enumerate(best[:wanted])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [1 << 13, 64])
def test_large_components_take_part_exactly(spark, block_rows):
    rng = random.Random(4)
    rows = vectors(200, 6, 5)
    for i, size in enumerate([524288.0, 1e6, 3e8, 1e15, 2.0**60, 1e30, 1e154, 1e300, 1.7e308] * 3):
        rows += [(300 + 10 * i, [rng.uniform(-size, size) for _ in range(6)]), (301 + 10 * i, [size] + [0.5, -0.25, 0.0, 3.0, -1e-9])]
    rows += [(900 + i, [-1e6] * 6) for i in range(8)]
    # Scores that doubles can't tell apart, and vectors that are alike.
    rows += [(950 + i, [2.0**70, -(2.0**70), i / 256, 1.0, 1.0, 1.0]) for i in range(12)] + [(1000, [2.0**70, 2.0**70, 1.0, 0.0, 0.0, 0.0])]
    rows += [(1100 + i, [2e6] * 6) for i in range(60)]
    rows += [(1200, [math.inf] * 6), (1250, [math.nan] + [1e9] * 5), (1300, [None] + [1e9] * 5), (1350, None)]
    # In range each, but their products' sum is not.
    rows += [(1400 + i, [524287.5] * 600) for i in range(3)]
    rng.shuffle(rows)
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), block_rows=block_rows)
    assert found.columns == ["query_id", "rank", "vec_id", "score", "whole_score"]
    got = found.collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.whole_score) for r in got) == wholly(rows)
    assert all(r.score == (int(r.whole_score) if abs(int(r.whole_score)) < 1 << 63 else None) for r in got)
    assert any(r.score is None for r in got)


def test_rows_move_once_and_wide_vectors_make_smaller_blocks(spark, monkeypatch):
    rows = vectors(300, 900, 8)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 2 * topk.SLICES * 900 * 100)
    found = topk.top_k(table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Generate") == 1
    assert re.search(r"hashpartitioning\(dims#\d+, block#\d+, 3\)", plan)
    got = found.collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.whole_score) for r in got) == wholly(rows)


def test_query_keeps_large_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (1, [600000.0, 0.0]), (2, [2.0, 0.0]), (50, [1e6, 1.0])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op9_topk(spark, str(tmp_path))
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    best = [(0, 1, 50, 65536 * 10**6), (0, 2, 1, 65536 * 600000), (0, 3, 2, 65536 * 2)]
    best += [(50, 1, 1, 65536 * 6 * 10**11), (50, 2, 2, 65536 * 2 * 10**6), (50, 3, 0, 65536 * 10**6)]
    assert sorted(map(tuple, found.collect())) == best
