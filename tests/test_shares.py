"""What one task gets of a table or a file does not grow with it."""

from pyspark.sql import functions as F

from veilframe import session
from veilframe.functions.crypto import vault_key
from veilframe.operators import dictionary, tokens
from veilframe.sources.files import write_named
from veilframe.sources.policies import Policy
from veilframe.sources.ranges import parts_of


def test_a_scanned_table_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t"))
    dealt = session.spread(spark.read.parquet(str(tmp_path / "t")))
    sizes = [len(rows) for rows in dealt.rdd.glom().collect()]
    assert sum(sizes) == 5000 and len(sizes) == 50 and max(sizes) < 200


def test_a_table_in_one_row_group_is_dealt_however_many_parts_its_scan_has(spark, tmp_path):
    spark.range(5000).selectExpr("id", "sha2(cast(id as string), 256) as text").coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        scanned = spark.read.parquet(str(tmp_path / "t"))
        assert scanned.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
        sizes = [len(rows) for rows in session.spread(scanned).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 5000 and max(sizes) < 1250


def test_small_ranges_share_tasks(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("".join(f'{{"n": {n}}}\n' for n in range(4000)))
    cut = parts_of(spark.createDataFrame([(str(path), "jsonl", path.stat().st_size)], "path string, reader string, length bigint"), 64)
    assert cut.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert b"".join(row.content for row in cut.orderBy("first_no").collect()) == path.read_bytes()


def test_lines_of_one_file_are_worked_out_by_many_tasks(spark, tmp_path):
    rows = spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id")
    write_named(rows.select(F.concat_ws(" ", "id", F.spark_partition_id()).alias("value")), str(tmp_path / "out" / "a.txt"))
    lines = [line.split() for line in (tmp_path / "out" / "a.txt").read_text().splitlines()]
    assert [int(number) for number, _ in lines] == list(range(1000))
    assert len({task for _, task in lines}) == 5
    assert [one.name for one in (tmp_path / "out").iterdir() if not one.name.startswith(".")] == ["a.txt"]


def test_a_long_term_list_builds_no_automaton_in_every_worker(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "_with_broadcast_spans", None)
    terms = spark.range(80_000).selectExpr("id as term_ord", "format_string('Customer#%09d', id) as term", "'PERSON' as entity_type")
    docs = spark.createDataFrame([("a", "of Customer#000000007, Customer#000079999"), ("b", "none")], "source_id string, text string")
    found = {row.source_id: [span.value for span in row._terms] for row in dictionary.add_term_spans(docs, terms, Policy()).collect()}
    assert found == {"a": ["Customer#000000007", "Customer#000079999"], "b": []}


def test_values_do_not_move_for_a_vault_that_knows_none(spark, monkeypatch):
    numbered, met = tokens.number_values, []
    monkeypatch.setattr(tokens, "number_values", lambda values, counters: met.append(values) or numbered(values, counters))
    rows = spark.createDataFrame([("a", "a", 0, "CUSTOMER", "x"), ("b", "b", 0, "CUSTOMER", "y")], "source_id string, doc_ord string, start int, entity_type string, value string")
    key = vault_key(spark, b"some secret")
    first = tokens.assign_tokens(rows, tokens.empty_vault(spark), key, "run-1")
    state = tokens.with_assignment(tokens.empty_vault(spark), first)
    more = rows.unionByName(rows.withColumn("value", F.lit("z")).limit(1))
    again = {row.value: row.token for row in tokens.assign_tokens(more, state, key, "run-2").tokens.collect()}
    assert again == {"x": "[VEIL_CUSTOMER_0001]", "y": "[VEIL_CUSTOMER_0002]", "z": "[VEIL_CUSTOMER_0003]"}
    plans = ["LeftAnti" in one._jdf.queryExecution().toString() for one in met]
    assert plans == [False, True]
