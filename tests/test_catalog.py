import json

import compare
import pytest

import __spark_entry__ as entry
from veilframe.plans import catalog, checks

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF_DIR)


def test_every_query_has_plain_sql():
    assert set(catalog.queries()) == set(checks.oracles())
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_plain_sql(spark, con, name):
    ours, plain = compare.both(spark, con, catalog.queries()[name], checks.oracles()[name], SF_DIR)
    assert ours == plain


def test_entry(spark):
    assert {row["entity_type"]: row["findings"] for row in entry.entry(spark).collect()} == {"EMAIL": 5, "BANK_CARD": 7}


def test_detection_needs_no_shuffle_and_reads_two_columns(spark):
    from veilframe.operators.detect import detect, findings
    from veilframe.sources.policies import Policy
    from veilframe.sources.tables import documents

    docs = documents(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id", "text")
    plan = findings(detect(docs, Policy()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("regexp_replace") < 40 and json.dumps(plan).count("BEGIN [A-Z ]") <= 6


def test_gate_counts_documents_of_any_language(spark, tmp_path):
    rows = [(i, "web", lang, "plain words") for i, lang in enumerate(["en", "fr", "de", "es", "it", None])]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.kind: tuple(r)[1:] for r in catalog.gate_unreadable(spark, str(tmp_path)).collect()}
    assert found == {"texts": (2, 0, False, False), "pdf": (3, 1, False, True), "images": (6, 4, True, True)}
