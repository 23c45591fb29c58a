import json
import os
import random
import re
import time

import numpy as np
import plain_model
import pyarrow.parquet as pq
import pytest
from made_texts import made, one
from pyspark.sql import functions as F
from test_detect import ALL_KINDS, FIRST, frame, random_texts, spark_spans

import veilframe
from veilframe import session
from veilframe.functions.crypto import vault_key
from veilframe.operators import dictionary
from veilframe.operators.detect import detect
from veilframe.operators.gate import leaks, with_document_verdict
from veilframe.operators.tokens import empty_vault, with_assignment
from veilframe.session import staged
from veilframe.sources.policies import Policy
from veilframe.sources.tables import documents
from veilframe.sources.vaults import VaultChanged, VaultFolder

TRIP = made(("PERSON", "ORG", "EMAIL", "PHONE", "MONEY"), 14)
ROUND_TRIP, LAST = TRIP.text, TRIP.fillers[-1]
RAW = tuple(TRIP.value(kind) for kind in ("PERSON", "ORG", "EMAIL", "PHONE"))
SHOWN = {"PERSON": "[X_PERSON_0001]", "ORG": "[X_ORG_0001]", "EMAIL": "[X_EMAIL_MASKED]", "PHONE": "[X_PHONE_REDACTED]", "MONEY": "[X_MONEY_100K_1M]"}


def docs_of(spark, texts):
    return documents(spark.createDataFrame(list(texts.items()), "id string, t string"), "id", "t")


@pytest.fixture(scope="module")
def key(spark):
    return vault_key(spark, b"secret of the tests")


class Late(VaultFolder):
    """A run that read the vault before another run committed."""

    def load(self):
        return empty_vault(self.spark)


def everything(*tables):
    return json.dumps([[row.asDict(True) for row in table.collect()] for table in tables], ensure_ascii=False)


def test_scan_reports_no_raw_values(spark):
    few = made(("CONTRACT_ID", "EMAIL", "PERSON", "PHONE"), 15)
    run = veilframe.scan(docs_of(spark, {"s.md": few.text}), run_id="r")
    rendered = everything(run.report, run.summary, run.documents, run.outputs)
    assert run.blocked is False and run.sanitized is None
    assert not any(value in rendered for value in few.values)
    assert run.summary.first()["counts_by_entity"] == {"CONTRACT_ID": 1, "EMAIL": 1, "PERSON": 1, "PHONE": 1}


def test_a_secret_blocks(spark, key, tmp_path):
    folder = VaultFolder(spark, str(tmp_path / "vault"))
    run = veilframe.prepare(docs_of(spark, {"a": FIRST, "b": ROUND_TRIP}), key, folder, output=str(tmp_path / "out"))
    assert run.blocked and run.sanitized is None
    assert not (tmp_path / "out").exists() and not folder.exists()
    assert ALL_KINDS.value("API_KEY") not in everything(run.report, run.summary, run.documents, run.outputs)


def test_prepare_writes_and_restore_brings_back(spark, key, tmp_path):
    folder = VaultFolder(spark, str(tmp_path / "vault"))
    docs = docs_of(spark, {"b/x y.md": ROUND_TRIP, "a.md": "nothing", "c.md": ""})
    run = veilframe.prepare(docs, key, folder, run_id="run-1", output=str(tmp_path / "out"), prefix="X")
    assert run.blocked is False
    run.write_report(str(tmp_path / "report"))
    parts = sorted((tmp_path / "out/bundle/run_id=run-1").glob("part=*/part-*.txt"))
    bundle = "".join(path.read_text("utf-8") for path in parts)
    assert TRIP.shown(*(SHOWN[kind] for kind in TRIP.kinds)) in bundle
    assert re.findall("## Source: (.*)", bundle) == ["a.md", "b/x y.md", "c.md"]
    assert bundle.startswith("# sanitized bundle\n\n## Source: a.md\n\nnothing\n\n")
    written = [p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()]
    assert not any(value.encode() in data for value in RAW for data in written)
    stored = spark.read.parquet(str(tmp_path / "out/documents"))
    assert {row["output_name"] for row in stored.collect()} == {"b_x_y.md.redacted.md", "a.md.redacted.md", "c.md.redacted.md"}
    back = {row["source_id"]: row for row in veilframe.restore(run.sanitized, key, folder, "run-1", prefix="X").collect()}
    brought = (value if kind in ("PERSON", "ORG") else SHOWN[kind] for kind, value in zip(TRIP.kinds, TRIP.values, strict=True))
    assert back["b/x y.md"]["text"] == TRIP.shown(*brought)
    assert (back["b/x y.md"]["restored"], back["b/x y.md"]["placeholders"], back["a.md"]["restored"]) == (2, 3, 0)


def plain_values(folder):
    """All that parquet files below a folder hold, as one string."""
    return "".join(str(pq.read_table(path).to_pydict()) for path in folder.rglob("*.parquet") if path.is_file())


def test_nothing_raw_stays_staged(spark, key, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path / "staging"))
    raw = (*RAW, ALL_KINDS.value("API_KEY"))
    run = veilframe.scan(docs_of(spark, {"a": FIRST, "b": ROUND_TRIP}))
    assert run.blocked and run.findings.where("value = '{}'".format(TRIP.value("PHONE"))).count() >= 1
    assert not any(value in plain_values(tmp_path) for value in raw)
    run = veilframe.prepare(docs_of(spark, {"a": FIRST, "b": ROUND_TRIP}), key, empty_vault(spark))
    assert run.blocked and not any(value in plain_values(tmp_path) for value in raw)
    leaking = {"notes/password=hunter2hunter2.md": ROUND_TRIP}
    run = veilframe.prepare(docs_of(spark, leaking), key, empty_vault(spark))
    assert run.blocked and f"{LAST} [" not in plain_values(tmp_path)
    run = veilframe.prepare(docs_of(spark, {"b": ROUND_TRIP}), key, empty_vault(spark))
    assert not run.blocked and f"{LAST} [" in plain_values(tmp_path)
    assert run.findings.where("value = '{}'".format(TRIP.value("PHONE"))).count() == 1
    assert not any(value in plain_values(tmp_path) for value in raw)
    assert not any(value.encode() in path.read_bytes() for path in tmp_path.rglob("*") if path.is_file() for value in raw)
    vault = with_assignment(empty_vault(spark), run.assignment)
    assert veilframe.restore(run.sanitized, key, vault).first()["restored"] == 2
    assert not any(value in plain_values(tmp_path) for value in raw)


def test_a_failing_run_leaves_nothing_staged(spark, key, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr("veilframe.operators.gate.leaks", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        veilframe.prepare(docs_of(spark, {"b": ROUND_TRIP}), key, empty_vault(spark))
    assert not list(tmp_path.iterdir())


def test_a_run_that_comes_second_releases_nothing(spark, key, tmp_path):
    folder = VaultFolder(spark, str(tmp_path / "vault"))
    late = Late(spark, folder.path)
    veilframe.prepare(docs_of(spark, {"a": made(("PERSON", "PHONE"), 16).text}), key, folder, run_id="run-1")
    with pytest.raises(VaultChanged):
        veilframe.prepare(docs_of(spark, {"a": made(("PERSON", "PHONE"), 17).text}), key, late, run_id="run-2", output=str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    state = folder.load()
    assert state.version == 1 and {row["run_id"] for row in state.token_runs.collect()} == {"run-1"}


def test_a_run_id_is_released_once(spark, key, tmp_path):
    docs = docs_of(spark, {"a": "text"})
    veilframe.prepare(docs, key, empty_vault(spark), run_id="run-1", output=str(tmp_path / "out"), bundle=False)
    with pytest.raises(Exception):
        veilframe.prepare(docs, key, empty_vault(spark), run_id="run-1", output=str(tmp_path / "out"), bundle=False)
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 1
    with pytest.raises(ValueError):
        veilframe.prepare(docs, key, empty_vault(spark), run_id="../x", output=str(tmp_path / "out"))


def test_token_order_is_path_order(spark, key):
    docs = docs_of(spark, {"a.txt": "李四", "a/z": "王五", "a": "赵六"})
    docs = docs.withColumn("path", F.concat(F.lit("/r/"), F.col("source_id")))
    run = veilframe.prepare(docs, key, empty_vault(spark), prefix="X")
    assert {row["value"]: row["token"][-5:-1] for row in run.assignment.tokens.collect()} == {"赵六": "0001", "王五": "0002", "李四": "0003"}


def test_repeated_ids_are_refused(spark, key):
    with pytest.raises(ValueError):
        veilframe.prepare(docs_of(spark, {"a": "x"}).unionByName(docs_of(spark, {"a": "y"})), key, empty_vault(spark))


def test_second_pass_sees_what_the_bundle_adds(spark, key, tmp_path):
    folder = VaultFolder(spark, str(tmp_path / "vault"))
    docs = docs_of(spark, {"notes/password=hunter2hunter2.md": "harmless"})
    run = veilframe.prepare(docs, key, folder, output=str(tmp_path / "out"))
    assert run.blocked and not (tmp_path / "out").exists() and not folder.exists()
    last = run.report.collect()[-1]
    assert (last["source_id"], last["entity_type"], last["action"]) == ("bundle.md", "PASSWORD", "fail")


def test_secret_joined_by_a_replacement_is_a_leak(spark):
    clean = docs_of(spark, {"a": "x"}).select("source_id", F.lit("password: [VEIL_PERSON_0001]").alias("text"))
    assert leaks(clean, Policy()).first()["entity_type"] == "PASSWORD"


def test_both_plans_of_a_tokenized_table_read_their_own_part(spark, key):
    from veilframe.operators.redact import HAS_TOKENS, needs_tokens, occurrences, redact_with_tokens
    from veilframe.operators.tokens import assign_tokens

    detected = detect(docs_of(spark, {"a": ROUND_TRIP, "b": "plain"}), Policy()).withColumn(HAS_TOKENS, needs_tokens())
    detected = staged(detected, "parts", HAS_TOKENS)
    done = redact_with_tokens(detected, assign_tokens(occurrences(detected), empty_vault(spark), key, "r").tokens)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert f"NOT {HAS_TOKENS}" in plan and "PartitionFilters: [isnotnull(has_tokens" in plan
    assert {row["source_id"]: row["text"][:6] for row in done.collect()} == {"a": (TRIP.fillers[0] + " [")[:6], "b": "plain"}


def test_staged_tables_can_be_dropped(spark):
    df = staged(spark.range(3), "drop")
    folder = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert df.count() == 3 and os.path.isdir(folder)
    session._STAGED[:], kept = [path for path in session._STAGED if path in folder], list(session._STAGED)
    assert session.drop_staged(spark) == 1
    assert not os.path.exists(folder)
    session._STAGED.extend(path for path in kept if os.path.isdir(path))


def test_verdict_per_document(spark):
    docs = docs_of(spark, {"a": FIRST, "b": ROUND_TRIP})
    docs = docs.unionByName(docs_of(spark, {"c": ""}).withColumn("status", F.lit("error")))
    rows = with_document_verdict(detect(docs, Policy())).collect()
    assert {row["source_id"]: row["blocked"] for row in rows} == {"a": True, "b": False, "c": True}


def test_random_runs_against_the_plain_model(spark, key):
    texts = [text for text in random_texts(600, 21, most=20) if "VEIL" not in text]
    policy = Policy(fail_on=(), entities={**Policy().entities, "ADDRESS": "tokenize", "DATE": "tokenize"})
    policy = Policy(fail_on=(), entities={k: "tokenize" if v == "fail" else v for k, v in policy.entities.items()})
    ids = {f"{n:05d}": text for n, text in enumerate(texts)}
    run = veilframe.prepare(docs_of(spark, ids), key, empty_vault(spark), policy, "r")
    expected, numbers, counters = {}, {}, {}
    from test_redact import placeholder

    for name, text in sorted(ids.items()):
        out, at = "", 0
        for start, end, entity, action, _ in plain_model.detect(text, policy):
            value = text[start:end]
            if action == "tokenize":
                if (entity, value) not in numbers:
                    counters[entity] = counters.get(entity, 0) + 1
                    numbers[(entity, value)] = counters[entity]
                put = f"[VEIL_{entity}_{numbers[(entity, value)]:04d}]"
            else:
                put = placeholder("VEIL", entity, action, value)
            out, at = out + text[at:start] + put, end
        expected[name] = out + text[at:]
    assert run.blocked is False
    got = {row["source_id"]: row["text"] for row in run.sanitized.collect()}
    assert got == expected


def term_table(spark, terms):
    rows = [(n, term, entity) for n, (term, entity) in enumerate(terms)]
    return spark.createDataFrame(rows, "term_ord bigint, term string, entity_type string")


TERMS = [("aa", "PERSON"), ("aba", "ORG"), ("b", "API_KEY"), ("ab", "CUSTOM"), ("中😀", "ORG"), ("aa", "ORG"), ("aba", "ORG"), ("张三丰", "PROJECT")]


def term_texts():
    rng = random.Random(9)
    return ["".join(rng.choice("aab中😀 x") for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["张三丰和张三", "a" * 9001, ""]


def test_dictionary_against_the_plain_model(spark):
    texts = term_texts()
    docs = dictionary.add_term_spans(frame(spark, texts), term_table(spark, TERMS), Policy())
    found = spark_spans(detect(docs, Policy(), terms="_terms"))
    for n, text in enumerate(texts):
        assert found[str(n)] == plain_model.detect(text, Policy(), TERMS), repr(text)


def test_hits_of_terms():
    find = dictionary._finder(["aa", "aba"])
    assert find("aaaabaaba") == [(0, 0, 2), (0, 2, 4), (0, 5, 7), (1, 3, 6), (1, 6, 9)]
    assert find(None) == []


def test_both_dictionary_plans_give_the_same(spark, monkeypatch):
    texts = term_texts() + ["x" * 4095 + "aba" + "y" * 5000 + "ab", "中" * 4094 + "中😀aa"]
    docs, terms = frame(spark, texts), term_table(spark, TERMS)
    first = spark_spans(dictionary._with_broadcast_spans(docs, terms, Policy()), "_terms")
    monkeypatch.setattr(dictionary, "BROADCAST_CHARS", 0)
    for group, bits in ((1 << 20, 27), (7, 12), (1 << 16, 7), (1 << 16, 6)):
        monkeypatch.setattr(dictionary, "GROUP_CHARS", group)
        monkeypatch.setattr(dictionary, "MOST_MARK_BITS", bits)
        joined = dictionary.add_term_spans(docs, terms, Policy())
        assert "Join" in joined._jdf.queryExecution().toString()
        assert spark_spans(joined, "_terms") == first


def test_short_and_very_long_terms_meet_by_the_join(spark):
    long = "Z" + "yx" * 500
    terms = [("a", "PERSON"), (long, "ORG"), ("bc", "PERSON"), (long[:-1], "PROJECT"), ("a", "ORG")]
    texts = ["a b a", f"..{long}..", long[:-1], "bcbc", "", "none"]
    docs = documents(spark.createDataFrame([(f"d{n}", t) for n, t in enumerate(texts)], "id string, t string"), "id", "t")
    found = dictionary.term_findings(docs, term_table(spark, terms)).select("source_id", "start", "end", "entity_type", "value").collect()
    expected = [
        (f"d{n}", m.start(), m.end(), entity, term)
        for n, text in enumerate(texts) for term, entity in terms for m in re.finditer(re.escape(term), text)
    ]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_cost_does_not_depend_on_the_longest_term(spark):
    long = "".join(random.Random(3).choice("abcdefgh") for _ in range(1_000_000))
    terms = [("a", "PERSON"), (long, "ORG"), (long[:-1] + "z", "ORG"), ("ab" * 500_000, "PROJECT")]
    texts = [f"x{long}y", "a" * 5, long[:-1], "ab" * 500_001, "no"] + ["bcd " * 20] * 3000
    docs = documents(spark.createDataFrame([(f"d{n}", t) for n, t in enumerate(texts)], "id string, t string").repartition(4), "id", "t")
    found = dictionary.term_findings(docs, term_table(spark, terms)).where("length(value) > 1").select("source_id", "start", "end").collect()
    assert sorted(map(tuple, found)) == [("d0", 1, 1_000_001), ("d3", 0, 1_000_000)]
    rolled = []
    looked = dictionary.Places(np.zeros(1 << 9, np.uint8), 12, [1, 1_000_000])
    real = dictionary.Rolling

    class Counted(real):
        def __init__(self, codes):
            rolled.append(len(codes))
            super().__init__(codes)

    dictionary.Rolling = Counted
    try:
        assert list(looked.of(["abc"] * 50)) == []
    finally:
        dictionary.Rolling = real
    assert rolled == [150]


def test_rolling_hashes_and_self_overlap():
    rng = random.Random(5)
    text = "".join(rng.choice("ab") for _ in range(300))
    rolling = dictionary.Rolling(dictionary._codes(text * 500))
    for length in (1, 7, 64, 70_000):
        starts = np.arange(0, 150_000 - length, 1 if length < 100 else 13)
        hashes = rolling.of(starts, length)
        assert len(set(hashes.tolist())) == len({(text * 500)[s : s + length] for s in starts.tolist()})
    for size in range(1, 9):
        for n in range(1 << size):
            term = f"{n:0{size}b}"
            assert dictionary.overlaps_itself(term) == any(term.startswith(term[-k:]) for k in range(1, size))


def test_terms_reach_prepare_and_its_second_pass(spark, key):
    docs = docs_of(spark, {"a": "Project Zephyr starts", "Zephyr-notes": "x"})
    run = veilframe.prepare(docs, key, empty_vault(spark), terms=term_table(spark, [("Zephyr", "PROJECT")]))
    assert {row["text"] for row in run.sanitized.collect()} == {"Project [VEIL_PROJECT_0001] starts", "x"}
    run = veilframe.prepare(
        docs_of(spark, {"Zephyr-notes": "x"}), key, empty_vault(spark), Policy(fail_on=("PROJECT",)),
        terms=term_table(spark, [("Zephyr", "PROJECT")]),
    )
    assert run.blocked is True


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(n).getName() for n in range(files.size()) if files.apply(n).getName().startswith("shuffle_")}


def test_staging_leaves_no_shuffle_behind(spark):
    before = shuffled(spark)
    df = staged(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert spark.conf.get(session.CLEANUP) == "false" and df.count() == 7


def test_spans_of_prepared_texts_travel_with_a_number(spark, key, monkeypatch):
    plans = []

    def recorded(df, label, *args, real=session.staged):
        if label == "sanitized":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label, *args)

    monkeypatch.setattr("veilframe.plans.runs.staged", recorded)
    run = veilframe.prepare(docs_of(spark, {"a": ROUND_TRIP, "b": "plain", "c": ROUND_TRIP}), key, empty_vault(spark), prefix="X")
    assert {row.source_id: row.text == TRIP.shown(*(SHOWN[kind] for kind in TRIP.kinds)) for row in run.sanitized.collect()} == {"a": True, "b": False, "c": True}
    assert "_home" not in plans[0] and run.sanitized.columns == ["source_id", "text"]


def test_values_are_opened_once_for_their_texts(spark, key):
    from veilframe.operators.redact import occurrences, redact_with_tokens
    from veilframe.operators.tokens import assign_tokens

    detected = detect(docs_of(spark, {"a": ROUND_TRIP, "b": "plain"}), Policy())
    done = redact_with_tokens(detected, assign_tokens(occurrences(detected), empty_vault(spark), key, "r").tokens)
    plan = done._jdf.queryExecution().executedPlan().toString().splitlines()
    tested = [line for line in plan if "Filter" in line and "aesDecrypt" in line]
    # Only where frequent values are looked for, behind the test of their uses.
    assert tested and all("uses" in line[: line.index("aesDecrypt")] for line in tested)
    assert {row["source_id"]: row["text"][:6] for row in done.collect()} == {"a": (TRIP.fillers[0] + " [")[:6], "b": "plain"}
