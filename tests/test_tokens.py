import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from veilframe.functions.crypto import decrypt, encrypt, hmac_sha256, identity, vault_key
from veilframe.operators import skew, tokens
from veilframe.operators.tokens import assign_tokens, empty_vault, number_values, with_assignment
from veilframe import session
from veilframe.sources import vaults
from veilframe.sources.vaults import VaultChanged, VaultFolder

SECRET = b"0123456789abcdef0123456789abcdef"


@pytest.fixture(scope="module")
def key(spark):
    return vault_key(spark, SECRET)


def places(spark, rows):
    return spark.createDataFrame(rows, "source_id string, doc_ord string, start int, entity_type string, value string")


def values(vault, key):
    plain = decrypt(F.col("value_enc"), F.col("identity"), key)
    return {(row[0], row[1]): row[2] for row in vault.token_map.select("entity_type", plain, "token").collect()}


FIRST = [("b", "b", 0, "PERSON", "Ada"), ("a", "a", 9, "PERSON", "Grace"), ("a", "a", 2, "ORG", "Ada"), ("b", "b", 5, "PERSON", "Grace")]


def test_hmac_and_identity(spark, key):
    row = spark.range(1).select(
        F.hex(hmac_sha256(F.lit(bytearray(b"msg")), key)).alias("mac"), identity(F.lit("ORG"), F.lit("值"), key).alias("id")
    ).first()
    derived = hmac.new(SECRET, b"identity", hashlib.sha256).digest()
    assert row["mac"] == hmac.new(derived, b"msg", hashlib.sha256).hexdigest().upper()
    digest = hmac.new(derived, b"ORG\0" + "值".encode(), hashlib.sha256).digest()
    assert row["id"] == base64.urlsafe_b64encode(digest).decode().rstrip("=")


def test_values_are_encrypted_and_bound_to_their_row(spark, key):
    row = spark.range(1).select(encrypt(F.lit("张三"), F.lit("id-1"), key).alias("enc")).first()
    assert "张三".encode() not in bytes(row["enc"])
    table = spark.createDataFrame([(bytearray(row["enc"]),)], "enc binary")
    assert table.select(decrypt(F.col("enc"), F.lit("id-1"), key)).first()[0] == "张三"
    with pytest.raises(Exception):
        table.select(decrypt(F.col("enc"), F.lit("id-2"), key)).collect()
    with pytest.raises(Exception):
        table.select(decrypt(F.col("enc"), F.lit("id-1"), vault_key(spark, b"other"))).collect()


def test_keys_do_not_show_in_plans(spark, key):
    df = spark.range(1).select(encrypt(F.lit("v"), F.lit("i"), key), identity(F.lit("E"), F.lit("v"), key))
    plan = df._jdf.queryExecution().toString()
    assert hmac.new(SECRET, b"enc", hashlib.sha256).hexdigest().upper() not in plan.upper().replace(" ", "")
    assert "VaultKey(...)" == repr(key)


def test_numbers_follow_document_order(spark, key):
    vault = with_assignment(empty_vault(spark), assign_tokens(places(spark, FIRST), empty_vault(spark), key, "run-1"))
    assert values(vault, key) == {
        ("PERSON", "Grace"): "[VEIL_PERSON_0001]",
        ("PERSON", "Ada"): "[VEIL_PERSON_0002]",
        ("ORG", "Ada"): "[VEIL_ORG_0001]",
    }


def test_numbers_are_dense_over_many_partitions(spark):
    rows = spark.range(30000).selectExpr(
        "if(id % 3 = 0, 'A', 'B') as entity_type", "cast(id as string) as value", "30000 - id as first_seen"
    )
    counters = spark.createDataFrame([("B", 12345)], "entity_type string, last_no bigint")
    got = number_values(rows.repartition(16), counters)
    check = got.groupBy("entity_type").agg(
        F.min("token_no"), F.max("token_no"), F.count_distinct("token_no"),
        F.corr("token_no", "first_seen"),
    )
    result = {row[0]: tuple(row)[1:] for row in check.collect()}
    assert result["A"][:3] == (1, 10000, 10000)
    assert result["B"][:3] == (12346, 32345, 20000)
    assert all(row[3] > 0.999 for row in result.values())


def test_tokens_grow_past_four_digits(spark, key):
    counters = spark.createDataFrame([("PERSON", 9999)], "entity_type string, last_no bigint")
    vault = tokens.Vault(empty_vault(spark).token_map, empty_vault(spark).token_runs, counters)
    assigned = assign_tokens(places(spark, [("a", "a", 0, "PERSON", "x")]), vault, key, "r")
    assert assigned.tokens.first()["token"] == "[VEIL_PERSON_10000]"


def test_folder_keeps_tokens_over_runs_purge_and_rekey(spark, key, tmp_path):
    folder = VaultFolder(spark, str(tmp_path / "vault"))
    assert not folder.exists() and folder.load().token_map.isEmpty()
    first = folder.load()
    assert folder.append(first, assign_tokens(places(spark, FIRST), first, key, "run-1")) == 1
    with pytest.raises(VaultChanged):
        folder.append(first, assign_tokens(places(spark, FIRST), first, key, "run-x"))

    again = [("c", "c", 0, "PERSON", "Ada"), ("c", "c", 9, "PERSON", "Edsger")]
    second = folder.load()
    folder.append(second, assign_tokens(places(spark, again), second, key, "run-2"))
    state = folder.load()
    assert values(state, key)[("PERSON", "Ada")] == "[VEIL_PERSON_0002]"
    assert values(state, key)[("PERSON", "Edsger")] == "[VEIL_PERSON_0003]"
    assert state.token_runs.count() == 5
    repeat = assign_tokens(places(spark, again), state, key, "run-2")
    assert repeat.new_runs.isEmpty() and repeat.new_map.isEmpty()

    purged, removed = tokens.purge_run(state, "run-1")
    assert removed.first()["removed"] == 2
    folder.overwrite(purged)
    state = folder.load()
    assert set(values(state, key)) == {("PERSON", "Ada"), ("PERSON", "Edsger")}
    # numbers are never given out twice
    after = assign_tokens(places(spark, [("d", "d", 0, "ORG", "New"), ("d", "d", 1, "PERSON", "Grace")]), state, key, "run-3")
    assert {row["token"] for row in after.tokens.collect()} == {"[VEIL_ORG_0002]", "[VEIL_PERSON_0004]"}

    new_key = vault_key(spark, b"new secret")
    folder.overwrite(tokens.rekey(state, key, new_key))
    state = folder.load()
    assert values(state, new_key) == {("PERSON", "Ada"): "[VEIL_PERSON_0002]", ("PERSON", "Edsger"): "[VEIL_PERSON_0003]"}
    known = assign_tokens(places(spark, [("e", "e", 0, "PERSON", "Ada")]), state, new_key, "run-4")
    assert known.new_map.isEmpty() and known.tokens.first()["token"] == "[VEIL_PERSON_0002]"
    status = {row["entity_type"]: (row["entries"], row["last_no"]) for row in tokens.status(state).collect()}
    assert status == {"PERSON": (2, 3), "ORG": (0, 1)}
    for path in (tmp_path / "vault").rglob("*.parquet"):
        assert b"Edsger" not in path.read_bytes()


def test_one_of_two_runs_wins_a_version(spark, key, tmp_path, monkeypatch):
    folder = VaultFolder(spark, str(tmp_path / "vault"))
    first = folder.load()
    monkeypatch.setattr(VaultFolder, "_check", lambda self, expected: None)  # both got past the early look
    assert folder.append(first, assign_tokens(places(spark, FIRST), first, key, "run-1")) == 1
    with pytest.raises(VaultChanged):
        folder.append(first, assign_tokens(places(spark, [("z", "z", 0, "PERSON", "Edsger")]), first, key, "run-x"))
    assert set(values(folder.load(), key)) == {("PERSON", "Grace"), ("PERSON", "Ada"), ("ORG", "Ada")}
    assert len(list((tmp_path / "vault").glob("v0*"))) == 1


def test_many_small_additions_are_compacted(spark, key, tmp_path, monkeypatch):
    monkeypatch.setattr(vaults, "COMPACT_EVERY", 3)
    folder = VaultFolder(spark, str(tmp_path / "vault"))
    for n in range(5):
        state = folder.load()
        folder.append(state, assign_tokens(places(spark, [("a", "a", 0, "PERSON", f"name {n}")]), state, key, f"run-{n}"))
    state = folder.load()
    assert state.version == 5 and folder._entry(5).base == 4
    assert values(state, key) == {("PERSON", f"name {n}"): f"[VEIL_PERSON_{n + 1:04d}]" for n in range(5)}
    assert state.token_runs.count() == 5


def test_restore_takes_one_pass_and_counts(spark, key):
    rows = FIRST + [("z", "z", 0, "ORG", "see [VEIL_ORG_0001] there")]
    vault = with_assignment(empty_vault(spark), assign_tokens(places(spark, rows), empty_vault(spark), key, "run-1"))
    texts = {
        "a": "[VEIL_PERSON_0001] and [VEIL_PERSON_0002], [VEIL_PERSON_0001]",
        "b": "[VEIL_ORG_0002] [VEIL_ORG_0001]",
        "c": "none [VEIL_EMAIL_MASKED]",
        "d": "[VEIL_PERSON_0099][VEIL_PERSON_0002]",
        "e": "[VEIL_PERSON_0001",
    }
    docs = spark.createDataFrame(list(texts.items()), "source_id string, text string")
    rows = {row["source_id"]: row for row in tokens.restore(docs, vault, key, "run-1").collect()}
    assert rows["a"]["text"] == "Grace and Ada, Grace" and rows["a"]["restored"] == 3
    assert rows["b"]["text"] == "see [VEIL_ORG_0001] there Ada"
    assert rows["c"]["text"] == texts["c"] and rows["c"]["placeholders"] == 1
    assert rows["d"]["text"] == "[VEIL_PERSON_0099]Ada" and (rows["d"]["restored"], rows["d"]["unresolved"]) == (1, 1)
    assert rows["e"]["text"] == texts["e"]
    other = {row["source_id"]: row["text"] for row in tokens.restore(docs, vault, key, "run-9").collect()}
    assert other["a"] == texts["a"]
    every = {row["source_id"]: row["text"] for row in tokens.restore(docs, vault, key).collect()}
    assert every["a"] == "Grace and Ada, Grace"


def test_restore_reads_the_texts_twice(spark, key, tmp_path, monkeypatch):
    vault = with_assignment(empty_vault(spark), assign_tokens(places(spark, FIRST), empty_vault(spark), key, "run-1"))
    spark.createDataFrame([("a", "[VEIL_PERSON_0001]")], "source_id string, text string").write.parquet(str(tmp_path / "texts"))
    plans = []

    def recorded(df, *args, real=tokens.staged):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args)

    monkeypatch.setattr(tokens, "staged", recorded)
    done = tokens.restore(spark.read.parquet(str(tmp_path / "texts")), vault, key)
    plans.append(done._jdf.queryExecution().executedPlan().toString())
    assert sum(plan.count("ReadSchema: struct<source_id:string,text:string>") for plan in plans) == 2
    assert done.first()["text"] == "Grace"


def test_restore_of_repeated_and_nameless_documents(spark, key):
    vault = with_assignment(empty_vault(spark), assign_tokens(places(spark, FIRST), empty_vault(spark), key, "run-1"))
    rows = [(None, "[VEIL_PERSON_0001]", 1), (None, "[VEIL_PERSON_0002] x", 2), ("a", "[VEIL_PERSON_0002]", 3), ("a", "[VEIL_PERSON_0001]", 4), ("a", None, 5)]
    docs = spark.createDataFrame(rows, "source_id string, text string, pos int")
    got = {row["pos"]: (row["source_id"], row["text"]) for row in tokens.restore(docs, vault, key).collect()}
    assert got == {1: (None, "Grace"), 2: (None, "Ada x"), 3: ("a", "Ada"), 4: ("a", "Grace"), 5: ("a", "")}


def test_a_hot_key_is_spread(spark):
    rows = spark.range(60000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) as k")
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("uses"), F.max("id").alias("v"))
    joined = skew.join_skewed(rows, lookup, ["k"], "uses", ["id"])
    assert joined.count() == 60000 and joined.select("id").distinct().count() == 60000
    copies = joined.where("k = 'hot'").agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    assert tuple(copies) == (20000, 59997, 59997)


def test_parts_of_a_hot_key_follow_its_uses(spark):
    rows = spark.range(10000).selectExpr("id", "case when id % 2 = 0 then 'half' when id % 10 = 1 then 'tenth' else cast(id as string) end as k")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("uses"))
    plan = skew.join_skewed(rows, counts, ["k"], "uses", ["id"])
    assert plan.count() == 10000
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(skew.LEAST_PARTS, skew.PARTS_PER_PARTITION * before)
    salted = skew.salted_lookup(counts, ["k"], "uses", counts)
    copies = {row["k"]: row["n"] for row in salted[1].groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert copies["half"] == parts // 2 and copies["tenth"] == -(-parts // 10) and copies["3"] == 1


def test_values_do_not_move_to_look_for_themselves_in_an_empty_vault(spark, key):
    values = places(spark, FIRST).withColumn("identity", identity(F.col("entity_type"), F.col("value"), key))
    vault = empty_vault(spark)
    for how in ("inner", "left_anti"):
        met = values.join(vault.token_map.select("identity"), "identity", how)
        assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()


def test_sorts_of_values_are_led_by_a_hash(spark):
    plan = tokens.distinct_values(places(spark, FIRST))._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" in plan and "Sort [entity_type" not in plan


def test_a_run_keeps_one_table_of_its_values(spark, key, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    assigned = assign_tokens(places(spark, FIRST), empty_vault(spark), key, "run-1")
    labels = {folder.name.split("-")[1]: folder for folder in tmp_path.iterdir()}
    held = [label for label, folder in labels.items() if spark.read.schema("value_enc binary").parquet(str(folder)).where("value_enc is not null").count()]
    assert held == ["numbered"]
    assert assigned.new_runs.count() == 3 and {row.token for row in assigned.tokens.collect()} == {row.token for row in assigned.new_map.collect()}


def two_runs(spark, key):
    first = assign_tokens(places(spark, FIRST), empty_vault(spark), key, "run-1")
    vault = with_assignment(empty_vault(spark), first)
    again = [("c", "c", 0, "PERSON", "Ada"), ("c", "c", 9, "PERSON", "Edsger")]
    return with_assignment(vault, assign_tokens(places(spark, again), vault, key, "run-2"))


def test_restore_knows_what_each_run_used(spark, key):
    vault = two_runs(spark, key)
    text = "[VEIL_PERSON_0001] [VEIL_PERSON_0002] [VEIL_PERSON_0003] [VEIL_ORG_0001]"
    docs = spark.createDataFrame([("a", text)], "source_id string, text string")
    got = {run: tokens.restore(docs, vault, key, run).first()["text"] for run in ("run-1", "run-2", "run-3", "")}
    assert got == {
        "run-1": "Grace Ada [VEIL_PERSON_0003] Ada",
        "run-2": "[VEIL_PERSON_0001] Ada Edsger [VEIL_ORG_0001]",
        "run-3": text,
        "": "Grace Ada Edsger Ada",
    }


def without_broadcasts(spark, make):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = make()
        return done, done._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moves_above_opening(plan):
    """Exchanges by token between where values are opened and the scan below."""
    below = plan[plan.index("tryeval"):]
    return below[: below.index("value_enc", below.index("FileScan"))].count("Exchange hashpartitioning(_hash")


def test_restore_moves_ciphertext_only_where_few_tokens_are_in_use(spark, key):
    vault = with_assignment(empty_vault(spark), assign_tokens(places(spark, FIRST), empty_vault(spark), key, "run-1"))
    most = spark.createDataFrame([("a", "[VEIL_PERSON_0001] [VEIL_PERSON_0002]")], "source_id string, text string")
    few = spark.createDataFrame([("a", "[VEIL_PERSON_0002]")], "source_id string, text string")
    done, plan = without_broadcasts(spark, lambda: tokens.restore(most, vault, key, "run-1"))
    assert done.first()["text"] == "Grace Ada"
    assert "LeftSemi" not in plan and moves_above_opening(plan) == 0
    done, plan = without_broadcasts(spark, lambda: tokens.restore(few, vault, key, "run-1"))
    assert done.first()["text"] == "Ada" and moves_above_opening(plan) > 0


def test_an_entry_that_cannot_be_opened_fails_only_where_it_is_needed(spark, key):
    vault = with_assignment(empty_vault(spark), assign_tokens(places(spark, FIRST), empty_vault(spark), key, "run-1"))
    broken = F.when(F.col("token") == "[VEIL_ORG_0001]", F.lit(bytearray(40))).otherwise(F.col("value_enc"))
    rows = vault.token_map.withColumn("value_enc", broken)
    state = tokens.Vault(rows, vault.token_runs, vault.counters)
    for text, shown in (("[VEIL_PERSON_0001] [VEIL_PERSON_0002] [VEIL_X_0001]", "Grace Ada [VEIL_X_0001]"), ("[VEIL_PERSON_0001]", "Grace")):
        docs = spark.createDataFrame([("a", text)], "source_id string, text string")
        row = tokens.restore(docs, state, key, "run-1").first()
        assert row["text"] == shown and row["unresolved"] == shown.count("[")
        docs = spark.createDataFrame([("a", f"{text} [VEIL_ORG_0001]" if "X" in text else "[VEIL_ORG_0001]")], "source_id string, text string")
        with pytest.raises(Exception):
            tokens.restore(docs, state, key, "run-1").collect()


def test_a_hot_key_is_spread_by_a_lookup_without_uses(spark):
    rows = spark.range(60000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) as k")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("uses"))
    lookup = rows.where("k = 'hot' or id % 2 = 0").groupBy("k").agg(F.max("id").alias("v"))
    joined = skew.join_skewed(rows, lookup, ["k"], "uses", ["id"], counts, "left")
    assert joined.count() == 60000 and joined.select("id").distinct().count() == 60000
    assert joined.where("k = 'hot' and v = 59997").count() == 20000
    assert joined.where("v is null").count() == rows.where("k != 'hot' and id % 2 = 1").count()
