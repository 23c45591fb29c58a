import random
import re

import plain_model
import pytest
from made_texts import FILLER, made, one
from pyspark.sql import functions as F

from veilframe.functions import rules, spans
from veilframe.functions.rules import BUILTIN_RULES, rules_named
from veilframe.functions.spans import NO_SPANS, SPANS_TYPE, evaluated_once
from veilframe.operators import detect as detection
from veilframe.operators import resolve
from veilframe.operators.detect import detect, findings, found_spans, has_fail
from veilframe.sources.policies import Policy

ALL_KINDS = made(("PERSON", "ORG", "PHONE", "EMAIL", "ID_CARD", "MONEY", "CONTRACT_ID", "API_KEY"), 11)
CODES = made(("ORG", "CUSTOMER", "PROJECT", "SAMPLE_ID"), 12)
FIRST, BUSINESS = ALL_KINDS.text, CODES.text
#: What stands before the last marker is not part of a name.
TRIMMED = one("ORG", 13)
TRIM = f"{FILLER[0]} 7组移交给{TRIMMED} {FILLER[1]}"
# A value of each kind for random texts, and such values cut short or in another case.
CARD, CUSTOMER, SAMPLE, CONTRACT = one("ID_CARD", 1), one("CUSTOMER", 2), one("SAMPLE_ID", 3), "HT" + one("CONTRACT_ID", 4).lstrip("XSCDAO")

PARTS = [
    "张三", "李四王五", "姓名：", "联系人 ", "代表", "甲方代表", "由", "在", "来自", "客户为", "客户", "给", "向", "公司",
    "科技", "有限公司", "生物科技有限公司", "研究中心", "大学", "医院", "集团", "海棠", "蓝鲸", "海洋", "（中国）", "(A)",
    "北京市", "海淀区", "中关村路", "8号楼", "园区", "省", "路", "，", "。", "：", ":", "=", " ", "  ", "\n", "\t", "\x1c", "\x85",
    "　", " ", "​", "-", "--", "_", ".", ",", "/", "@", "%", "+", "'", '"', ";", "😀", "é", "é", "²", "Ⅷ", "①",
    "ſ", "K", "ı", "İ", "ß", "1", "2", "0", "9", "12", one("PHONE", 5), "１２", "٣", "12345678901234567890", "2026", "1999",
    "2026年6月", "2026-06-22", "2026/1/3日", "月", "日", CARD[:17] + "X", CARD[:17], "4000 1111 2222 3333 ",
    "4000111122223333", one("USCC", 8), "ABCDEFGHJK12345678", CONTRACT, "ht2031abc", "NDA", "po-", "SO2026-", CUSTOMER,
    CUSTOMER.lower().replace("s", "ſ") + "1", "cust-", "SAMPLE-20260622-A17", "sample-20260622-K17", "sample-", "Delta-Ice-Probe-2031", "a-b-12", "A-b-1２",
    "-x-34", "-12", "-345", "-20261", "Ab1", "x1-y-22", "人民币", "RMB", "¥", "$", "元", "万元", "万", "美元", "USD", "1,234.50", "5",
    "eyJ", "abcdefghijk", "ABCDEFGHIJ_-", "sk-", "proj-", "test_", "live_", "abcdefghijklmnopqrstuvwx", "AKIA", "ABCDEFGHIJKLMNOP", "ghp_",
    "ghs_", "cookie", "Set-Cookie", "cooKie", "COOKİE", "password", "paſſword", "PWD", "secret", "passwd", "hunter2hunter2", "a@b.co",
    one("EMAIL", 7), "\0", "x.y+z@sub-domain.org", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----",
]


# Characters by number, as they are hard to tell from others: Kelvin sign, dotted
# and dotless i, long s, spaces of several kinds, a combining accent, a joiner.
PARTS += [chr(n) for n in (0x212A, 0x130, 0x131, 0x17F, 0x3000, 0xA0, 0x2003, 0x200B, 0x1C, 0x1F, 0x85, 0x301, 0x200D)]
PARTS += ["coo" + chr(0x212A) + "ie", "cook" + chr(0x130) + "e", "cook" + chr(0x131) + "e", "pa" + chr(0x17F) * 2 + "word", CUSTOMER.lower().replace("s", chr(0x17F))]
PARTS += ["HT2031" + chr(0x212A) + "AB", SAMPLE.lower()[:-3] + chr(0x212A) + "17", "x" + chr(0x17F) + "2026abc", chr(0x212A) + CONTRACT + chr(0x131)]


def random_texts(count, seed, most=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, most))) for _ in range(count)]


def spark_spans(detected, column="spans"):
    rows = detected.select("source_id", column).collect()
    return {
        row["source_id"]: [(s.start, s.end, s.entity_type, s.action, s.detector) for s in row[column]] for row in rows
    }


def frame(spark, texts):
    rows = [(str(n), text) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "source_id string, text string").repartition(8)


def test_sentence_with_all_kinds(spark):
    detected = detect(frame(spark, [FIRST]), Policy())
    rows = findings(detected).collect()
    assert [(row["entity_type"], row["value"]) for row in rows] == list(zip(ALL_KINDS.kinds, ALL_KINDS.values, strict=True))
    assert {row["entity_type"] for row in rows if row["action"] == "fail"} == {"API_KEY"}


def test_business_identifiers(spark):
    rows = findings(detect(frame(spark, [BUSINESS]), Policy())).collect()
    assert [(row["entity_type"], row["value"]) for row in rows] == list(zip(CODES.kinds, CODES.values, strict=True))


def test_action_text_before_an_organisation_is_left_out(spark):
    orgs = [row for row in findings(detect(frame(spark, [TRIM]), Policy())).collect() if row["entity_type"] == "ORG"]
    assert [row["value"] for row in orgs] == [TRIMMED]


def test_values_are_the_text_at_their_offsets(spark):
    texts = [FIRST, "😀" + BUSINESS, "é😀" + TRIM]
    for row in findings(detect(frame(spark, texts), Policy())).collect():
        assert texts[int(row["source_id"])][row["start"] : row["end"]] == row["value"]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_detector_against_the_plain_model(spark, seed):
    texts = random_texts(6000, seed)
    found = spark_spans(found_spans(frame(spark, texts), Policy()), "found")
    for n, text in enumerate(texts):
        expected = sorted((a, b, e, act, d) for a, b, e, act, _, _, d in plain_model.raw(text, Policy()))
        assert sorted(found[str(n)]) == expected, repr(text)


@pytest.mark.parametrize("seed", [3, 4])
def test_resolution_against_the_plain_model(spark, seed):
    texts = random_texts(2500, seed, most=40)
    found = spark_spans(detect(frame(spark, texts), Policy()))
    for n, text in enumerate(texts):
        assert found[str(n)] == plain_model.detect(text, Policy()), repr(text)


def test_fail_check_equals_fail_findings(spark):
    texts = random_texts(4000, 5, most=14) + [FIRST]
    policy = Policy(fail_on=("API_KEY", "PASSWORD", "COOKIE", "JWT", "PRIVATE_KEY", "PROJECT", "ORG", "PERSON"))
    rows = detect(frame(spark, texts), policy).withColumn("failed", has_fail(policy)).collect()
    for row in rows:
        assert row["failed"] == any(s.action == "fail" for s in row["spans"]), repr(row["text"])


def test_long_chains_do_not_overflow(spark):
    chain = "Ab" + "-cd1" * 40000
    texts = [chain + "-2026", chain, "x" * 200000 + "@", "中" * 60000, "中" * 60000 + "市" + "中" * 10]
    found = spark_spans(detect(frame(spark, texts), Policy()))
    assert [s[:3] for s in found["0"]] == [(0, len(chain) + 5, "PROJECT")]
    assert found["1"] == [] and found["2"] == [] and found["3"] == []
    assert (0, 60001, "ADDRESS") in [s[:3] for s in found["4"]]


def test_many_spans_in_one_document(spark):
    text = " ".join(f"1380000{n:04d}" for n in range(5000))
    found = spark_spans(detect(frame(spark, [text]), Policy()))["0"]
    assert [s[:2] for s in found] == [(12 * n, 12 * n + 11) for n in range(5000)]


def test_very_many_overlapping_spans_in_one_document(spark):
    # contract codes hold project codes and dates; every contract wins its place
    text = " ".join(f"HT-2026-{n % 9000 + 1000}, 2026-06-{n % 28 + 1:02d}" for n in range(30000))
    found = spark_spans(detect(frame(spark, [text]), Policy()))["0"]
    assert [s[:3] for s in found[:2]] == [(0, 12, "CONTRACT_ID"), (14, 24, "DATE")]
    assert [(s[0], s[1]) for s in found] == [
        place for n in range(30000) for place in ((25 * n, 25 * n + 12), (25 * n + 14, 25 * n + 24))
    ]


def dense_spans(seed):
    """Spans in discovery order that overlap a lot: of all lengths, in chains that rank up, down and up and down."""
    rng = random.Random(seed)
    if seed % 4 == 0:
        ranks = (lambda n: n, lambda n: -n, lambda n: abs(n % 80 - 40), lambda n: n * 7919 % 997)[seed // 4 % 4]
        return [(2 * n, 2 * n + 3, "mask", 0.5 + ranks(n) / 10000, 20, 0) for n in range(1500)]
    count, room = rng.choice([65, 200, 900]), rng.choice([50, 300, 3000])
    spans = []
    for _ in range(count):
        start = rng.randrange(room)
        length = rng.choice([0, 1, 2, 3, 5, 8, 20, room // 3]) if seed % 2 else rng.randint(1, 9)
        kind = rng.choice(["fail", "mask"]), rng.choice([0.7, 0.8, 0.95]), rng.choice([20, 80]), rng.randrange(4)
        spans.append((start, start + length, *kind))
    return sorted(spans, key=lambda span: span[5])


@pytest.mark.parametrize("sweeps", [resolve.SWEEPS, 1])
def test_large_clusters_against_the_plain_model(spark, monkeypatch, sweeps):
    monkeypatch.setattr(resolve, "SWEEPS", sweeps)
    cases = {seed: dense_spans(seed) for seed in range(40)}
    rows = [
        (seed, [(a, b, "E", act, conf, prio, place, "d", "low", str(n)) for n, (a, b, act, conf, prio, place) in enumerate(spans)])
        for seed, spans in cases.items()
    ]
    found = spark.createDataFrame(rows, f"seed int, found {SPANS_TYPE}").repartition(8)
    kept = found.selectExpr("seed", f"{evaluated_once(resolve.resolve_sql('found'), NO_SPANS)} as spans").collect()
    for row in kept:
        raw = [(a, b, "E", act, conf, prio, str(n)) for n, (a, b, act, conf, prio, _) in enumerate(cases[row["seed"]])]
        assert [(s.start, s.end, s.value) for s in row["spans"]] == [(a[0], a[1], a[6]) for a in plain_model.accepted(raw)]


def test_many_names_under_one_address(spark):
    count = 6000
    text = "".join("张三李四王五"[n % 3 * 2 : n % 3 * 2 + 2] for n in range(count)) + "市"
    found = spark_spans(detect(frame(spark, [text]), Policy()))["0"]
    assert [s[:3] for s in found] == [(2 * n, 2 * n + 2, "PERSON") for n in range(count)]


def test_rules_can_be_chosen(spark):
    detected = detect(frame(spark, [FIRST]), Policy(), rules_named("email", "cn-phone"))
    assert {row["entity_type"] for row in findings(detected).collect()} == {"EMAIL", "PHONE"}
    assert len(BUILTIN_RULES) == 23


def test_null_text_has_no_spans(spark):
    assert spark_spans(detect(frame(spark, [None, ""]), Policy())) == {"0": [], "1": []}


def test_single_matches_take_compiled_functions_only(spark):
    """Where no rule matches twice, spans come from plain functions; they equal those of the interpreted ones."""
    plain = [rule for rule in BUILTIN_RULES if not rule.terms]
    assert not any("->" in spans._single("c", rule, spans._about(0, rule, {rule.entity: "mask"})) for rule in plain)
    texts = ["", "编号CUST-2020-123456，合同HT-2020-0001，邮箱 a.b@c.example.com。", "GZO-ab-12-345和aa-bb-cc-dd", "a@b.example.com c@d.example.com",
             "张三在广东省南山区", "a\0b 13812345678", "供应商：海山科技有限公司，", "𠀀13812345678"]
    docs, checks = detection._with_checks(frame(spark, texts), BUILTIN_RULES, "text")
    actions = {rule.entity: Policy().action_for(rule.entity) for rule in BUILTIN_RULES}
    interpreted = docs.select(F.expr(spans.found_sql(spans.text_of("text"), BUILTIN_RULES, checks, actions, "_nul")).alias("found"), "source_id")
    compiled = found_spans(frame(spark, texts), Policy())
    assert [row.found for row in compiled.orderBy("source_id").collect()] == [row.found for row in interpreted.orderBy("source_id").collect()]
    assert any(row.found for row in interpreted.collect())


def test_sign_of_a_project_code():
    """Codes of customers and contracts have none, so their texts are not cut for it; whatever is kept has one."""
    sign = re.compile(rules.PROJECT_SIGN)
    assert not any(map(sign.search, ["编号CUST-2020-000012345。", "HT-2020-000012345", "2020-01-02", "a-12", "-a-x", "a-b-12345", "a-" * 20000 + "b"]))
    assert all(map(sign.search, ["GZO-ab-12-345", "aa-bb-12", "1-2-a-b-12-x", "A1--b-c-34", "x-1-2-33", "-9-q-w-1234-"]))


def test_texts_without_a_needed_character_are_not_searched(spark):
    from veilframe.functions.rules import BUILTIN_RULES
    from veilframe.functions.spans import possible

    texts = ["Cookie and password of a customer", "password: swordfish-1", "Cookie=abcdefghijkl", "CUST-٢٠٢٠-١٢٣", "¥ ٥", "日期 2020年1月", "张三"]
    needing = {rule.detector: rule for rule in BUILTIN_RULES if rule.needs}
    assert {"cookie", "password", "customer-id", "money", "cn-date"} <= set(needing)
    docs = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "n int, text string")
    tests = [f"{possible('text', rule)} as `{name}`" for name, rule in needing.items()]
    rows = {row.n: {name for name in needing if row[name]} for row in docs.selectExpr("n", *tests).collect()}
    assert rows[0] == set() and rows[6] == set()
    assert "password" in rows[1] and "cookie" in rows[2] and "customer-id" in rows[3] and "money" in rows[4] and "cn-date" in rows[5]


def test_signs_are_found_wherever_their_rule_matches():
    import itertools
    import re

    from veilframe.functions.rules import BUILTIN_RULES

    by_name = {rule.detector: rule for rule in BUILTIN_RULES if rule.detector in ("contract-id", "cn-date")}
    codes = ["".join(parts) for parts in itertools.product(("HT", "xs", "NDa", "cDA", "pO", "ſO", "XſX", "XS", "CUST", "QT"), ("-", ""), ("2020", "٢٠٢٠"), ("-1A", "000", ""))]
    dates = ["".join(parts) for parts in itertools.product(("1999", "2020", "2099", "1899"), "年/-", ("0", "1", "01", "10", "12", "13", "00"), ("", "月3日", "-31", "0012"))]
    for name, texts in (("contract-id", codes), ("cn-date", dates)):
        rule = by_name[name]
        flags = re.I if rule.ignore_case else 0
        matching = [text for text in texts if re.search(rule.pattern, text, flags)]
        assert matching and all(re.search(rule.sign, text) for text in matching)
        assert rule.sign and not re.search(rule.sign, "编号CUST-2020-000012345。")
