"""Commits that break off at every step, tombstones, and lookups that leave the vault's rows where they are."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F
from test_tokens import places, values

from veilframe.functions.crypto import vault_key
from veilframe.operators import tokens
from veilframe.operators.tokens import assign_tokens
from veilframe.sources import vaults
from veilframe.sources.vaults import VaultChanged, VaultFolder


@pytest.fixture(scope="module")
def key(spark):
    return vault_key(spark, b"secret of the tests")


def named(spark, *names):
    return places(spark, [("a", "a", n, "PERSON", name) for n, name in enumerate(names)])


def add(folder, key, run_id, *names):
    state = folder.load()
    return folder.append(state, assign_tokens(named(folder.spark, *names), state, key, run_id))


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("v"))


@pytest.fixture()
def folder(spark, key, tmp_path):
    made = VaultFolder(spark, str(tmp_path / "vault"), buckets=3)
    add(made, key, "run-1", "Ada")
    return made


def goes_on(folder, key, version=2):
    assert folder.load().version == version - 1
    assert add(folder, key, "run-2", "Ada", "Grace") == version
    assert set(values(folder.load(), key).values()) == {"[VEIL_PERSON_0001]", "[VEIL_PERSON_0002]"}


@pytest.mark.parametrize("call", [1, 2, 3])
def test_death_while_tables_are_written(folder, key, tmp_path, monkeypatch, call):
    calls = []

    def breaks(self, table, *args, write=VaultFolder._write_table):
        calls.append(1)
        if len(calls) == call:
            raise OSError("disk")
        write(self, table, *args)

    with monkeypatch.context() as patch:
        patch.setattr(VaultFolder, "_write_table", breaks)
        if call == 3:
            patch.setattr(VaultFolder, "_check", lambda self, expected: len(calls) < 2 or 1 / 0)
        with pytest.raises((OSError, ZeroDivisionError)):
            add(folder, key, "lost", "Edsger")
    assert len(folders(tmp_path / "vault")) == 1
    goes_on(folder, key)


def test_death_before_the_claim_is_seen(folder, key, tmp_path, monkeypatch):
    with monkeypatch.context() as patch:
        patch.setattr(VaultFolder, "_move", lambda self, *names: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            add(folder, key, "lost", "Edsger")
    assert len(folders(tmp_path / "vault")) == 2
    goes_on(folder, key)
    kept = {folder._entry(version).folder for version in (1, 2)}
    assert folder.sweep(3600) == 0 and folder.sweep(0) == 1
    assert set(folders(tmp_path / "vault")) == kept
    goes_on_again = add(folder, key, "run-3", "Barbara")
    assert goes_on_again == 3


def test_an_error_after_the_commit_is_a_commit(folder, key, monkeypatch):
    def late(self, *args, publish=VaultFolder._publish):
        publish(self, *args)
        raise OSError("no answer")

    monkeypatch.setattr(VaultFolder, "_publish", late)
    assert add(folder, key, "run-2", "Grace") == 2
    assert len(values(folder.load(), key)) == 2


def test_a_commit_that_finds_another_marker_raises(folder, key, tmp_path, monkeypatch):
    state = folder.load()
    assigned = assign_tokens(named(folder.spark, "Edsger"), state, key, "slow")

    def slow(self, version, entry, publish=VaultFolder._publish):
        publish(self, version, vaults.Entry(1, folders(tmp_path / "vault")[0], 3))

    monkeypatch.setattr(VaultFolder, "_publish", slow)
    with pytest.raises(VaultChanged):
        folder.append(state, assigned)
    assert len(folders(tmp_path / "vault")) == 1


def test_a_marker_taken_away_is_no_commit(folder, key, tmp_path, monkeypatch):
    with monkeypatch.context() as patch:
        patch.setattr(VaultFolder, "_publish", lambda self, *args: None)
        with pytest.raises(VaultChanged):
            add(folder, key, "slow", "Edsger")
    goes_on(folder, key)


@pytest.mark.parametrize("content", ["", '{"base": 1, "fol', "{}", "[1]"])
def test_half_made_markers_are_waited_for_then_set_aside(folder, key, tmp_path, content):
    marker = tmp_path / "vault/commits/000002"
    marker.write_text(content)
    with pytest.raises(VaultChanged):
        folder.load()
    with pytest.raises(VaultChanged):
        add(folder, key, "run-2", "Grace")
    long_ago = time.time() - 1000
    os.utime(marker, (long_ago, long_ago))
    goes_on(folder, key)
    assert len(list((tmp_path / "vault/commits").glob(".000002-*.abandoned"))) == 1


def test_a_marker_that_is_completed_late_counts(folder, key, tmp_path, monkeypatch):
    assert add(folder, key, "run-2", "Grace") == 2
    marker = tmp_path / "vault/commits/000002"
    content = marker.read_text()
    marker.write_text("")
    (tmp_path / "vault/commits/.000002.crc").unlink(missing_ok=True)
    os.utime(marker, (1, 1))

    def finishes(self, name, target, move=VaultFolder._move):
        if target.endswith(".abandoned"):
            marker.write_text(content)
        move(self, name, target)

    monkeypatch.setattr(VaultFolder, "_move", finishes)
    assert folder.load().version == 2 and len(values(folder.load(), key)) == 2


def test_a_name_is_given_once(folder, tmp_path):
    (tmp_path / "vault/one").write_text("1")
    (tmp_path / "vault/two").write_text("2")
    with pytest.raises(Exception):
        folder._move("one", "two")
    assert (tmp_path / "vault/two").read_text() == "2"


def test_a_store_without_a_safe_way_is_refused(folder, key, monkeypatch, tmp_path):
    monkeypatch.setattr(vaults, "RENAMING", ())
    with pytest.raises(RuntimeError, match="without replacing"):
        add(folder, key, "run-2", "Grace")
    assert len(folders(tmp_path / "vault")) == 1


def test_purges_are_tombstones_until_the_state_is_compacted(spark, key, tmp_path, monkeypatch):
    folder = VaultFolder(spark, str(tmp_path / "vault"), buckets=2)
    add(folder, key, "run-1", "Ada", "Grace")
    add(folder, key, "run-2", "Grace", "Edsger")
    add(folder, key, "run-3", "Barbara")
    before = {p: p.stat().st_mtime for p in tmp_path.rglob("*.parquet")}
    assert folder.purge("run-1") == 1 and folder.purge("none") == 0
    new = [p for p in tmp_path.rglob("*.parquet") if p not in before]
    assert {p.parent.name for p in new} == {"gone"}
    assert sum(spark.read.parquet(str(p)).count() for p in new) == 1
    state = folder.load()
    assert {name for _, name in values(state, key)} == {"Grace", "Edsger", "Barbara"}
    assert {row["run_id"] for row in state.token_runs.collect()} == {"run-2", "run-3"}
    # A value met again gets a new number; a run of the purged name counts again.
    add(folder, key, "run-1", "Ada")
    assert values(folder.load(), key)[("PERSON", "Ada")] == "[VEIL_PERSON_0005]"
    assert folder.purge("run-2") == 2
    version = folder.compact()
    assert folder._entry(version).base == version
    assert {name for _, name in values(folder.load(), key)} == {"Ada", "Barbara"}
    assert folder.sweep(0) == version - 1 and {name for _, name in values(folder.load(), key)} == {"Ada", "Barbara"}
    for n in range(vaults.COMPACT_PURGES + 2):
        assert folder.purge(f"none-{n}") == 0
    entries = folder._entries(folder.load().version)
    assert 0 < sum(entry.purged is not None for entry in entries) <= vaults.COMPACT_PURGES
    assert folder.purge("run-1") == 1 and folder.purge("run-3") == 1 and folder.load().token_map.isEmpty()
    assert VaultFolder(spark, str(tmp_path / "new")).purge("run-1") == 0


def above_scans(plan):
    """For each scan of vault rows, the operators between it and the join above it."""
    lines = [(len(re.match(r"[\s:|+-]*", line).group()), line) for line in plan.splitlines()]
    for at, (depth, line) in enumerate(lines):
        if "Bucketed: true" in line:
            way = []
            for up in range(at - 1, -1, -1):
                if lines[up][0] < depth:
                    depth = lines[up][0]
                    way.append(lines[up][1])
                    if "Join" in lines[up][1]:
                        break
            yield way


def test_lookups_leave_the_vault_where_it_is(spark, key, tmp_path, monkeypatch):
    folder = VaultFolder(spark, str(tmp_path / "vault"), buckets=5)
    add(folder, key, "run-1", "Ada", "Grace")
    add(folder, key, "run-2", "Edsger")
    folder.purge("run-2")
    plans = []

    def recorded(df, *args, real=tokens.staged):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args)

    monkeypatch.setattr(tokens, "staged", recorded)
    monkeypatch.setattr(VaultFolder, "_write_table", lambda self, table, *args: plans.append(table._jdf.queryExecution().executedPlan().toString()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = folder.load()
        assigned = assign_tokens(named(spark, "Ada", "Barbara"), state, key, "run-3")
        plans.append(assigned.new_runs._jdf.queryExecution().executedPlan().toString())
        plans.append(tokens.only_used_by(state, "run-1")._jdf.queryExecution().executedPlan().toString())
        ways = [way for plan in plans for way in above_scans(plan)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joined = [way for way in ways if "Join" in way[-1]]
    assert len(joined) >= 6
    # Identities of a run, which are its own rows only, may move; rows of the vault do not.
    moved = [way for way in joined if any("Exchange" in line for line in way)]
    assert all(any("run_id" in line and "= run-1" in line for line in way) for way in moved)
    assert {row["value"]: row["token"] for row in assigned.tokens.collect()} == {"Ada": "[VEIL_PERSON_0001]", "Barbara": "[VEIL_PERSON_0004]"}
    assert assigned.new_runs.where(F.col("run_id") == "run-3").count() == 2
