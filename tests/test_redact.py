import random

import plain_model
from pyspark.sql import functions as F
from test_detect import frame, random_texts

from veilframe.functions.replacements import bucket_sql, month_sql
from veilframe.operators.detect import detect
from veilframe.operators.redact import redact
from veilframe.sources.policies import Policy


def month(value):
    import re

    found = re.search(r"((?:19|20)\d{2})[年/-](1[0-2]|0?[1-9])", value)
    return f"{found[1]}-{int(found[2]):02d}" if found else "MONTH"


def bucket(value):
    digits = "".join(c for c in value if c.isdecimal() or c == ".")
    try:
        amount = float(digits)
    except ValueError:
        return "BUCKET"
    amount *= 10000 if "万" in value else 1
    names = ((1e3, "LT_1K"), (1e4, "1K_10K"), (1e5, "10K_100K"), (1e6, "100K_1M"))
    return next((name for limit, name in names if amount < limit), "GT_1M")


def placeholder(prefix, entity, action, value):
    if action == "month_only":
        return f"[{prefix}_DATE_{month(value)}]"
    if action == "bucket":
        return f"[{prefix}_MONEY_{bucket(value)}]"
    ending = {"mask": "MASKED", "redact": "REDACTED", "generalize": "GENERALIZED"}.get(action, "REPLACED")
    return f"[{prefix}_{entity}_{ending}]"


def redacted(text, policy, prefix="P"):
    out, at = "", 0
    for start, end, entity, action, _ in plain_model.detect(text, policy):
        if action != "fail":
            out += text[at:start] + placeholder(prefix, entity, action, text[start:end])
            at = end
    return out + text[at:]


def test_buckets_and_months(spark):
    amounts = ["999.99元", "1000元", "9,999.99", "10000", "¥5万", "99.9999万元", "100万", "1000000", "１２３４元", "٣元", "", "元", "1.2.3", ".5", "5."]
    dates = ["2026-01-05", "2026-1-25", "2026/10/3", "2026年11月2日", "1999-12", "2026-9", "no", "２０２６-05", "2026-123"]
    rows = [("b", value, bucket(value)) for value in amounts] + [("m", value, month(value)) for value in dates]
    frame_ = spark.createDataFrame(rows, "kind string, v string, expected string")
    got = frame_.withColumn("got", F.expr(f"if(kind = 'b', {bucket_sql('v')}, {month_sql('v')})")).collect()
    for row in got:
        assert row["got"] == row["expected"], row


def test_redacted_texts_against_the_plain_model(spark):
    policy = Policy(entities={**Policy().entities, "PERSON": "mask", "ORG": "hide", "PROJECT": "generalize", "CONTRACT_ID": "redact"})
    policy = Policy(entities={name: action if action != "tokenize" else "mask" for name, action in policy.entities.items()})
    texts = random_texts(3000, 11, most=30)
    got = {row["source_id"]: row["text"] for row in redact(detect(frame(spark, texts), policy), "P").collect()}
    for n, text in enumerate(texts):
        assert got[str(n)] == redacted(text, policy), repr(text)


def test_long_texts_with_many_spans(spark):
    rng = random.Random(3)
    policy = Policy()
    texts = []
    for _ in range(3):
        words = [rng.choice(["word", "😀", "中", "15900001234", "a@b.co", "x" * 50]) for _ in range(4000)]
        texts.append(" ".join(words))
    got = {row["source_id"]: row["text"] for row in redact(detect(frame(spark, texts), policy), "P").collect()}
    for n, text in enumerate(texts):
        expected = " ".join(
            {"15900001234": "[P_PHONE_REDACTED]", "a@b.co": "[P_EMAIL_MASKED]"}.get(word, word) for word in text.split(" ")
        )
        assert got[str(n)] == expected
