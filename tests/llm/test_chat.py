import hashlib
import random

from pyspark.sql import functions as F

from veilframe.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(rows):
    """n_turns, turns digest, loss length and digest by conversation."""
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, said in talks.items():
        said.sort()
        loss = "".join(text for *_, role, text in said if role == "assistant")
        turns = "".join(f"{role}\n{text}\n" for *_, role, text in said)
        out[conv] = (len(said), sha(turns), len(loss), sha(loss))
    return out


def conversations(number=60):
    rng = random.Random(6)
    pieces = ["<turn>", "</turn>\n", "&", "&lt;", "&amp;lt;", "&#10;", "\\", "\n", "assistant", "é", "😀", " ok", "", "<"]
    rows = []
    for conv in range(number):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "assistant", None, "a\nb<", "&#10;"])
            rows.append((conv, turn, role, rng.choice([None, "".join(rng.choice(pieces) for _ in range(6))])))
    return rows


def test_escapes_are_reversible(spark):
    texts = [(text or "",) for *_, text in conversations()]
    df = spark.createDataFrame(texts, "text string").withColumn("shown", chat.escaped(F.col("text")))
    assert df.where(chat.unescaped(F.col("shown")) != F.col("text")).count() == 0
    assert df.where(F.col("shown").contains("<")).count() == 0


def test_read_back_gives_every_turn_and_each_reply_once(spark):
    rows = conversations()
    rows += [(None, 1, "user", "no id"), (None, 2, "assistant", "yes"), (99, 3, "assistant", "same"), (99, 3, "assistant", "same")]
    rows += [(98, None, "assistant", "first"), (98, 1, "user", "x"), (97, 0, "user", "long " * 100_000), (97, 1, "assistant", "y" * 300_000)]
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("said", F.lit(1)).withColumn("shown", F.lit("<")).repartition(5)
    found = chat.read_back(chat.examples(turns)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == plainly(rows)


def test_examples_hold_the_turns_before_and_train_one_reply(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a<b"), (1, 2, "assistant", "one & two"), (1, 3, "user", "c"), (1, 4, "assistant", "é"), (1, 5, "user", "bye")]
    made = chat.examples(spark.createDataFrame(rows, SCHEMA)).orderBy("last_turn").collect()
    first = "<turn>system\ns</turn>\n<turn>user\na&lt;b</turn>\n<turn>assistant\none &amp; two</turn>\n"
    second = first + "<turn>user\nc</turn>\n<turn>assistant\né</turn>\n"
    assert [(r.last_turn, r.formatted) for r in made] == [(3, first), (5, second), (6, second + "<turn>user\nbye</turn>\n")]
    trained = [r.formatted[r.loss_start : r.loss_start + r.loss_length] for r in made]
    assert trained == ["one &amp; two", "é", ""]


def test_examples_of_a_long_conversation_need_not_fit_into_one_row(spark):
    # 1,500 examples, 2.3 GB of text in all: more than any row can hold.
    turns = spark.range(1500).select(
        F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"),
        F.rpad(F.col("id").cast("string"), 2000, "x").alias("text"),
    )
    size = len("<turn>assistant\n") + 2000 + len("</turn>\n")
    made = chat.examples(turns)
    trained = F.expr("substring(formatted, loss_start + 1, loss_length)") == F.rpad((F.col("last_turn") - 1).cast("string"), 2000, "x")
    found = made.agg(F.count(F.lit(1)), F.sum(F.length("formatted")), F.count_if(trained), F.sum("last_turn")).first()
    assert tuple(found) == (1500, size * 1500 * 1501 // 2, 1500, 1500 * 1501 // 2)


def test_plan_has_one_shuffle_and_no_python(spark):
    turns = spark.createDataFrame(conversations(), SCHEMA)
    plan = chat.read_back(chat.examples(turns))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_nothing_in_gives_nothing_out(spark):
    assert chat.read_back(chat.examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_marked_conversation_is_in_the_query(spark):
    row = queries.op2_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert (row.n_turns, row.turns_sha256) == (2, sha(f"user\n{text}\nassistant\n{text}\n"))
    assert (row.loss_chars, row.loss_sha256) == (len(text), sha(text))
