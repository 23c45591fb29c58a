"""What only the joined bundle shows, against one search over the whole of it."""

import random
import re

import pytest
import veilframe
from test_runs import docs_of

from veilframe.functions.crypto import vault_key
from veilframe.functions.rules import COOKIE, PASSWORD, PRIVATE_KEY
from veilframe.operators import gate
from veilframe.operators.tokens import empty_vault
from veilframe.sources.policies import Policy

OPENING, CLOSING = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def plainly(texts):
    """(section, until, start, end) of key blocks over borders, from the joined text."""
    joined, places = "", []
    for name, text in sorted(texts.items()):
        joined += "\n" if joined else ""
        places.append((len(joined), name))
        joined += f"## Source: {name}\n\n{text}\n"

    def place(at):
        return max(one for one in places if one[0] <= at)

    out = []
    for found in re.finditer(PRIVATE_KEY, joined):
        (a, first), (b, last) = place(found.start()), place(found.end() - 1)
        if first != last:
            out.append((first, last, found.start() - a, found.end() - b))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_key_blocks_over_any_number_of_sections(spark, seed):
    rng = random.Random(seed)
    parts = [OPENING, CLOSING, " a ", "\n", "key", "-----BEGIN PRIVATE KEY----"]
    weights = [2, 2, 3, 2, 2, 1] if seed % 2 else [1, 1, 9, 9, 9, 1]
    texts = {f"d{n:03d}": " ".join(rng.choices(parts, weights, k=rng.randint(0, 4))) for n in range(120)}
    found = gate.crossing_leaks(docs_of(spark, texts), Policy()).where("detector = 'private-key'")
    assert sorted((r.section, r.until, r.start, r.end) for r in found.collect()) == plainly(texts)


def test_other_rules_across_a_border(spark):
    texts = {"a": "fine", "b": "Cookie:", "c": "x" * 3000 + " cookie = ", "d": "cookie: 123456789012", "e": "pwd:", "f": "end"}
    rows = gate.crossing_leaks(docs_of(spark, texts), Policy()).collect()
    assert sorted((r.section, r.until, r.start, r.end, r.detector) for r in rows) == [
        ("b", "c", 14, 12, "cookie"), ("c", "d", 3015, 12, "cookie"),
    ]
    assert re.search(COOKIE, "cookie:\n\n## Source: x\n") and not re.search(PASSWORD, "pwd:\n\n## Source: x\n")
    assert gate.crossing_leaks(docs_of(spark, {"b": "Cookie:"}), Policy()).isEmpty()
    assert gate.crossing_leaks(docs_of(spark, texts).limit(0), Policy()).isEmpty()
    assert gate.crossing_leaks(docs_of(spark, texts), Policy(fail_on=(), entities={})).isEmpty()


def test_a_bundle_with_a_split_key_is_not_written(spark, tmp_path):
    key = vault_key(spark, b"secret of the tests")
    docs = docs_of(spark, {"a": f"text {OPENING} abc", "b": "between", "c": f"def {CLOSING}"})
    run = veilframe.prepare(docs, key, empty_vault(spark), output=str(tmp_path / "out"))
    assert run.blocked and run.sanitized is None and not (tmp_path / "out").exists()
    assert [(r.source_id, r.entity_type) for r in run.report.collect()] == [("bundle.md", "PRIVATE_KEY")]
    run = veilframe.prepare(docs, key, empty_vault(spark), output=str(tmp_path / "apart"), bundle=False)
    assert not run.blocked and spark.read.parquet(str(tmp_path / "apart/documents")).count() == 3
