import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import simhash
from veilframe.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, bits):
    label = {i: i for i in range(len(prints))}
    for _ in prints:
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if bin(p ^ q).count("1") <= bits:
                    label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for i, root in label.items():
        groups.setdefault(root, []).append(ids[i])
    return [min((x for x in groups[label[i]] if x is not None), default=None) for i in range(len(prints))]


def test_fingerprint_agrees_with_its_definition(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \t\r\n", "one", "One TWO", "a b c", "É É é É", "x\x85y z\xa0w v u", "a\x1fb c d\x00e f g"]
    texts += [" ".join(rng.choice(["foo", "Bar", "baz", "qüx", "三"]) for _ in range(n)) for n in (3, 4, 50, 700)]
    expected = [plain_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) & (2**64 - 1) for t in texts] == expected
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert [simhash.fingerprint(t) & (2**64 - 1) for t in texts] == expected


def test_every_word_has_one_home_within_the_covering_radius():
    words = np.random.default_rng(1).integers(0, 1 << 32, 2000, dtype=np.uint64)
    at = simhash.syndromes(words)
    home = words ^ np.where(at > 0, np.uint64(1) << at.astype(np.uint64), np.uint64(0))
    assert not simhash.syndromes(home).any()
    assert np.bitwise_count(words ^ home).max() == 1
    patterns, counts = simhash.error_patterns(2)
    near = words[:, None] ^ patterns[at]
    assert all((simhash.syndromes(row[:n]) == 0).all() for row, n in zip(near, counts[at], strict=True))
    assert all(len(set(row[:n].tolist())) == n for row, n in zip(near, counts[at], strict=True))
    assert counts.max() == 17


def clustered(rng, n):
    prints = []
    for _ in range(n):
        base = rng.choice(prints) if prints and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            base ^= 1 << rng.randrange(64)
        prints.append(base)
    return prints


def linked(spark, prints, bits, limit):
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(set(prints))]
    found = components(simhash.links(spark.createDataFrame(signed, "fp long"), bits, limit))
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in found.collect()}
    groups = {}
    for p in set(prints):
        groups.setdefault(roots.get(p, p), set()).add(p)
    return sorted(map(sorted, groups.values()))


def plainly_linked(prints, bits):
    prints, left, out = sorted(set(prints)), set(prints), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            p = todo.pop()
            group.add(p)
            near = {q for q in left if bin(p ^ q).count("1") <= bits}
            left -= near
            todo += near
        out.append(sorted(group))
    return sorted(out)


def test_links_find_all_components(spark):
    rng = random.Random(7)
    prints = clustered(rng, 400) + [0, (1 << 64) - 1, 1, 1 << 63]
    for bits in (0, 1, 2, 3):
        assert linked(spark, prints, bits, 2048) == plainly_linked(prints, bits)


def test_large_cells_are_dealt_to_finer_anchors(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = [base]
    for _ in range(300):
        prints.append(rng.choice(prints) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    prints += clustered(rng, 100)
    assert linked(spark, prints, 2, 5) == plainly_linked(prints, 2)


def test_long_chains_of_components(spark):
    rng = random.Random(3)
    names = list(range(1000))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(500)] + [(names[800], names[801]), (5, 5), (5, 5)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    roots = {r.node: r.root for r in found.collect()}
    assert {roots[n] for n in names[:501]} == {min(names[:501])}
    assert roots[names[800]] == roots[names[801]] == min(names[800], names[801])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = [None, "", "  ", "same words here", "SAME words   here", "two words"]
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([20, 200, 600]))]
        texts.append(" ".join(words))
        for _ in range(4):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(60000)))
    rows = [(100 - i, t, "x", i, "y") for i, t in enumerate(texts)] + [(None, "two words", "x", 1, "y")]
    rows += [(None, "only here and nowhere else", None, None, None), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, cell int, Root string")
    found = simhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components([r[0] for r in rows], prints, 2)
    expected = [(r[0], f"{p:016x}", root) for r, p, root in zip(rows, prints, roots, strict=True)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_nothing_in_gives_nothing_out(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.near_duplicates(docs.withColumn("more", F.lit(1)), cell_limit=1).count() == 0
