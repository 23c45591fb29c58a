"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions.crypto import identity, vault_key
from veilframe.functions.rules import rules_for
from veilframe.functions.spans import NO_SPANS, SPANS_TYPE, evaluated_once
from veilframe.operators import audit, gate, tokens
from veilframe.operators.detect import detect, findings, has_fail
from veilframe.operators.dictionary import add_term_spans, term_findings
from veilframe.operators.redact import HAS_TOKENS, needs_tokens, occurrences, redact, redact_with_tokens
from veilframe.operators.resolve import resolve_sql
from veilframe.plans import runs
from veilframe.plans.carriers import CARRIERS, CUST_CODE, NOTE, padded
from veilframe.session import sensitive, shared_folder, spread, staged
from veilframe.sources import files
from veilframe.sources.policies import STRICT_DICTIONARIES, Policy, load_policy
from veilframe.sources.tables import documents, joined_documents
from veilframe.sources.terms import read_terms
from veilframe.sources.vaults import VaultChanged, VaultFolder

Query = Callable[[SparkSession, str], DataFrame]
POLICY = Policy()
# Keys of the example runs on the given tables; real keys come from the caller.
SECRET = b"example secret for the given tables"
NEW_SECRET = b"another example secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir) -> DataFrame:
    return documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def _every_text(spark, sf_dir) -> DataFrame:
    """Documents, conversation turns, pages and benchmark items as documents."""

    def part(name: str, key: str, text: str) -> DataFrame:
        rows = spread(table(spark, sf_dir, name))
        return documents(rows, F.expr(f"concat('{name}/', {key})"), F.col(text))

    return (
        part("documents", "doc_id", "text")
        .unionByName(part("conversations", "concat(conv_id, '/', turn)", "text"))
        .unionByName(part("pages", "page_id", "html"))
        .unionByName(part("benchmark", "item_id", "text"))
    )


def _carried(spark, sf_dir, name: str) -> DataFrame:
    carrier = CARRIERS[name]
    rows = spread(table(spark, sf_dir, carrier.table))
    return documents(rows, F.expr(padded(carrier.key)), F.expr(carrier.text))


def _notes(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return documents(spread(orders), F.expr(padded("o_orderkey")), F.expr(NOTE))


def spans_out(found: DataFrame) -> DataFrame:
    return found.select(
        "source_id",
        F.col("start").cast("bigint").alias("start_pos"),
        F.col("end").cast("bigint").alias("end_pos"),
        "entity_type",
        "action",
        "detector",
        "value",
    )


# --- detection --------------------------------------------------------------


def _carrier_query(name: str) -> Query:
    return lambda spark, sf_dir: spans_out(findings(detect(_carried(spark, sf_dir, name), POLICY)))


def detect_email(spark, sf_dir):
    return spans_out(findings(detect(_documents(spark, sf_dir), POLICY, rules_for("EMAIL"))))


def detect_bank_card(spark, sf_dir):
    return spans_out(findings(detect(_documents(spark, sf_dir), POLICY, rules_for("BANK_CARD"))))


def scan_every_text(spark, sf_dir):
    return spans_out(findings(detect(_every_text(spark, sf_dir), POLICY)))


def counts_by_entity(spark, sf_dir):
    return audit.counts_by_entity(findings(detect(_documents(spark, sf_dir), POLICY)))


def _terms(rows: DataFrame, column: str, entity: str) -> DataFrame:
    return (
        rows.select(F.col(column).alias("term"))
        .distinct()
        .select(F.xxhash64("term").alias("term_ord"), "term", F.lit(entity).alias("entity_type"))
    )


def _ordered_by(spark, sf_dir) -> DataFrame:
    """A sentence per order that names its customer."""
    named = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")).join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.expr("o_custkey = c_custkey")
    )
    text = "concat('Order of ', c_name, ', status ', o_orderstatus)"
    return documents(named, F.expr(padded("o_orderkey")), F.expr(text))


def dictionary_scan(spark, sf_dir):
    terms = _terms(table(spark, sf_dir, "customer"), "c_name", "PERSON")
    docs = add_term_spans(_ordered_by(spark, sf_dir), terms, POLICY)
    return spans_out(findings(detect(docs, POLICY, terms="_terms")))


def dictionary_join(spark, sf_dir):
    terms = _terms(table(spark, sf_dir, "customer"), "c_name", "PERSON")
    hits = term_findings(_ordered_by(spark, sf_dir), terms)
    return hits.select(
        "source_id", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"),
        "entity_type", "value",
    )


def dictionary_products(spark, sf_dir):
    """Product names in a text per line item, before overlaps are settled."""
    parts = table(spark, sf_dir, "part")
    lines = spread(table(spark, sf_dir, "lineitem")).join(parts.select("p_partkey", "p_name", "p_type"), F.expr("l_partkey = p_partkey"))
    docs = documents(lines, F.expr(LINE_KEY), F.expr("concat('ship ', p_name, ' (', p_type, '), spare ', p_name)"))
    docs = add_term_spans(docs, _terms(parts, "p_name", "PROJECT"), POLICY)
    found = docs.select(F.inline("_terms"))
    return found.groupBy("value", "start", "end").agg(F.count(F.lit(1)).alias("found")).select(
        "value", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"), "found"
    )


# --- resolution, actions, redaction -----------------------------------------


# Five overlapping spans per line item: (start, length, confidence, fails when, priority).
OVERLAPS = (
    ("l_partkey % 30", "cast(l_quantity as int) % 9", "l_discount", "false", "l_suppkey % 3"),
    ("l_suppkey % 30", "(l_partkey + l_linenumber) % 11", "l_tax", "l_returnflag = 'R'", "1"),
    ("l_orderkey % 30", "l_suppkey % 8", "cast(0.05 as double)", "false", "l_partkey % 2"),
    ("(l_partkey + l_suppkey) % 30", "l_orderkey % 10", "l_discount", "l_linestatus = 'O'", "1"),
    ("(l_orderkey + l_linenumber) % 30", "l_linenumber", "cast(0.07 as double)", "false", "0"),
)
LINE_KEY = "concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey, '/', cast(cast(l_extendedprice as decimal(15,2)) as string))"


def resolve_overlaps(spark, sf_dir):
    """Spans made of line item numbers, resolved within their row."""
    spans = ", ".join(
        f"""named_struct('start', cast({start} as int), 'end', cast({start} + {length} as int),
            'entity_type', 'T{n}', 'action', if({fails}, 'fail', 'mask'), 'confidence', {confidence},
            'priority', cast({priority} as int), 'place', {n}, 'detector', 'd', 'risk', 'medium', 'value', '')"""
        for n, (start, length, confidence, fails, priority) in enumerate(OVERLAPS)
    )
    lines = spread(table(spark, sf_dir, "lineitem")).selectExpr(
        f"{LINE_KEY} as source_id", f"{evaluated_once(f'cast(array({spans}) as {SPANS_TYPE})', NO_SPANS)} as found"
    )
    resolved = lines.selectExpr("source_id", f"{evaluated_once(resolve_sql('found'), NO_SPANS)} as spans")
    return resolved.select("source_id", F.inline("spans")).select(
        "source_id", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"),
        "entity_type", "action",
    )


def policy_actions(spark, sf_dir):
    """Findings per entity type with the action a policy of one's own gives."""
    policy = Policy(name="own", default_action="redact", entities={"EMAIL": "generalize", "PHONE": "mask"}, fail_on=("DATE",))
    found = findings(detect(_notes(spark, sf_dir), POLICY))
    return found.groupBy("entity_type").agg(F.count(F.lit(1)).alias("found")).withColumn(
        "action", policy.action_column(F.col("entity_type"))
    )


def _redacted_carrier(name: str) -> Query:
    return lambda spark, sf_dir: redact(detect(_carried(spark, sf_dir, name), POLICY)).select("source_id", "text")


def redact_notes(spark, sf_dir):
    """Every way to replace a span that needs no token."""
    policy = Policy(entities={**POLICY.entities, "CUSTOMER": "generalize", "CONTRACT_ID": "hide"})
    return redact(detect(_notes(spark, sf_dir), policy)).select("source_id", "text")


def redact_documents(spark, sf_dir):
    return redact(detect(_documents(spark, sf_dir), POLICY)).select("source_id", "text")


# --- tokens -----------------------------------------------------------------


def _assigned(spark, sf_dir, detected, state=None, run_id="run-1"):
    return tokens.assign_tokens(
        occurrences(detected), state or tokens.empty_vault(spark), vault_key(spark, SECRET), run_id
    )


def assign_tokens(spark, sf_dir):
    assigned = _assigned(spark, sf_dir, detect(_notes(spark, sf_dir), POLICY))
    return assigned.tokens.select("entity_type", "value", "token", "uses")


def _two_runs(spark, sf_dir):
    """A first run over the finished orders, a second over all of them."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"))

    def codes(rows):
        return documents(rows, F.expr(padded("o_orderkey")), F.expr(f"concat('编号', {CUST_CODE}, '。')"))

    first = _assigned(spark, sf_dir, detect(codes(orders.where("o_orderstatus = 'F'")), POLICY))
    state = tokens.with_assignment(tokens.empty_vault(spark), first)
    state = tokens.Vault(*(staged(t, "vault") for t in (state.token_map, state.token_runs, state.counters)))
    second = _assigned(spark, sf_dir, detect(codes(orders), POLICY), state, "run-2")
    return second, tokens.with_assignment(state, second)


def assign_tokens_again(spark, sf_dir):
    second, _ = _two_runs(spark, sf_dir)
    return second.tokens.select("entity_type", "value", "token")


def run_membership(spark, sf_dir):
    _, state = _two_runs(spark, sf_dir)
    return state.token_runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("entries"))


def purge_first_run(spark, sf_dir):
    """Nothing is removed with the first run, as the second met all its values."""
    _, state = _two_runs(spark, sf_dir)
    once, removed_first = tokens.purge_run(state, "run-2")
    _, removed_both = tokens.purge_run(once, "run-1")
    return (
        removed_first.select(F.lit("run-2").alias("purged"), "removed")
        .unionByName(removed_both.select(F.lit("run-1").alias("purged"), "removed"))
    )


def rekey_vault(spark, sf_dir):
    """Values of a vault after a change of key, and whether identities follow."""
    _, state = _two_runs(spark, sf_dir)
    new = vault_key(spark, NEW_SECRET)
    changed = tokens.rekey(state, vault_key(spark, SECRET), new)
    value = tokens.decrypt(F.col("value_enc"), F.col("identity"), new)
    opened = changed.token_map.select("token", value.alias("value"), "entity_type", "identity")
    fresh = identity(F.col("entity_type"), F.col("value"), new)
    return opened.select("token", "value", (F.col("identity") == fresh).alias("identity_follows"))


def vault_status(spark, sf_dir):
    _, state = _two_runs(spark, sf_dir)
    return tokens.status(state)


def keyed_identity(spark, sf_dir):
    key = vault_key(spark, SECRET)
    return table(spark, sf_dir, "customer").select("c_custkey", identity(F.lit("PERSON"), F.col("c_name"), key).alias("identity"))


def tokenize_notes(spark, sf_dir):
    detected = detect(_notes(spark, sf_dir), POLICY).withColumn(HAS_TOKENS, needs_tokens())
    detected = staged(detected, "notes", HAS_TOKENS)
    assigned = _assigned(spark, sf_dir, detected)
    return redact_with_tokens(detected, assigned.tokens).select("source_id", "text")


def prepare_notes(spark, sf_dir):
    """The whole run: detection, gate, tokens, splice, second pass."""
    run = runs.prepare(_notes(spark, sf_dir), vault_key(spark, SECRET), tokens.empty_vault(spark), run_id="run-1")
    return run.sanitized.select("source_id", "text", F.lit(run.blocked).alias("blocked"))


def restore_notes(spark, sf_dir):
    """Contract and customer codes there and back."""
    policy = Policy(entities={"CONTRACT_ID": "tokenize", "CUSTOMER": "tokenize", "EMAIL": "tokenize"})
    rules = rules_for("CONTRACT_ID", "CUSTOMER", "EMAIL")
    key = vault_key(spark, SECRET)
    run = runs.prepare(_notes(spark, sf_dir), key, tokens.empty_vault(spark), policy, "run-1", rules=rules)
    state = tokens.with_assignment(tokens.empty_vault(spark), run.assignment)
    back = tokens.restore(run.sanitized, state, key, "run-1")
    return back.select("source_id", "text", "restored", "unresolved", F.col("placeholders").cast("bigint").alias("placeholders"))


def restore_popular(spark, sf_dir):
    """There and back where one customer code fills half of all tokens."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    text = F.expr(f"concat('编号CUST-2020-0000001。编号', {CUST_CODE}, '。')")
    policy = Policy(entities={"CUSTOMER": "tokenize"})
    key = vault_key(spark, SECRET)
    docs = documents(orders, F.expr(padded("o_orderkey")), text)
    run = runs.prepare(docs, key, tokens.empty_vault(spark), policy, "run-1", rules=rules_for("CUSTOMER"))
    back = tokens.restore(run.sanitized, tokens.with_assignment(tokens.empty_vault(spark), run.assignment), key, "run-1")
    return back.select("source_id", "text", "restored", F.col("placeholders").cast("bigint").alias("placeholders"))


# --- gates and audit --------------------------------------------------------


def gate_documents(spark, sf_dir):
    detected = detect(_carried(spark, sf_dir, "key_blocks"), POLICY)
    return gate.with_document_verdict(detected).select("source_id", "blocked")


def gate_texts(spark, sf_dir):
    """The same verdict without working out any span."""
    return _carried(spark, sf_dir, "key_blocks").select("source_id", has_fail(POLICY).alias("blocked"))


def gate_run(spark, sf_dir):
    """Verdicts of a clean and of a failing run."""
    clean = gate.run_verdict(detect(_notes(spark, sf_dir), POLICY), for_release=True)
    failing = gate.run_verdict(detect(_carried(spark, sf_dir, "secrets"), POLICY), for_release=False)
    return clean.withColumn("run", F.lit("notes")).unionByName(failing.withColumn("run", F.lit("secrets")))


def gate_unreadable(spark, sf_dir):
    """Verdicts of a scan and of a release, as more kinds of files join in: texts, then PDF, then images."""
    path = "concat('/data/', source, '/', doc_id, case lang when 'en' then '.md' when 'fr' then '.txt' when 'de' then '.pdf' else '.png' end)"
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    level = "case lang when 'en' then 1 when 'fr' then 1 when 'de' then 2 else 3 end as level"
    out = []
    with sensitive(spark) as raw:
        # Six runs read the files, so they are dealt to tasks once; deleted with the last run.
        raw.add("files")
        every = staged(rows.selectExpr(level, f"{path} as path", "encode(text, 'UTF-8') as content"), "files")
        for upto, kind in enumerate(("texts", "pdf", "images"), 1):
            docs = files.extract(every.where(F.col("level") <= upto).drop("level"), "/data")
            scanned = runs.scan(docs, POLICY, run_id=kind)
            released = runs.prepare(docs, vault_key(spark, SECRET), tokens.empty_vault(spark), POLICY, run_id=kind)
            counts = scanned.documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "error").alias("unread"))
            out.append(
                counts.select(
                    F.lit(kind).alias("kind"), "documents", "unread",
                    F.lit(scanned.blocked).alias("scan_blocked"), F.lit(released.blocked).alias("release_blocked"),
                )
            )
    return out[0].unionByName(out[1]).unionByName(out[2])


def blocked_writes_nothing(spark, sf_dir):
    """A release of texts with secrets: what it says, and what it leaves behind."""
    target = _target(spark, "blocked")
    folder = VaultFolder(spark, f"{target}/vault")
    run = runs.prepare(_carried(spark, sf_dir, "secrets"), vault_key(spark, SECRET), folder, POLICY, "run-1", output=f"{target}/out")
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    left = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return run.summary.select("blocked", "finding_count", F.lit(left).alias("left_behind"))


class _EarlierState(VaultFolder):
    """The vault as a run saw it that started before another one committed."""

    def load(self):
        return tokens.empty_vault(self.spark)


def clashing_runs(spark, sf_dir):
    """Two runs from one state of a vault: entries and released documents of each."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"))
    target, key = _target(spark, "clash"), vault_key(spark, SECRET)
    text = F.expr(f"concat('编号', {CUST_CODE}, '。')")
    folder = VaultFolder(spark, f"{target}/vault")
    first = documents(orders.where("o_orderstatus = 'F'"), F.expr(padded("o_orderkey")), text)
    runs.prepare(first, key, folder, POLICY, "run-1", output=f"{target}/out", bundle=False)
    try:
        later = documents(orders, F.expr(padded("o_orderkey")), text)
        runs.prepare(later, key, _EarlierState(spark, folder.path), POLICY, "run-2", output=f"{target}/out", bundle=False)
    except VaultChanged:
        pass
    entries = folder.load().token_runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("entries"))
    released = spark.read.parquet(f"{target}/out/documents").groupBy("run_id").agg(F.count(F.lit(1)).alias("documents"))
    return entries.join(released, "run_id", "full")


class _Dying(VaultFolder):
    """The vault of a run whose driver dies when its tables are written and nothing is committed yet."""

    def _publish(self, version, entry):
        raise ConnectionError("the driver died")


def _half_made(folder: VaultFolder, version: int, content: str) -> None:
    """A marker that a driver left behind an hour ago, on a store where files are seen before they are complete."""
    files, marker = folder._hadoop(folder._marker(version))
    folder._write_file(files.createFile(marker).recursive().overwrite(False), content)
    files.setTimes(marker, int((time.time() - 3600) * 1000), -1)


def _code_documents(orders, status: str | None = None) -> DataFrame:
    """A customer code per order (of a status)."""
    rows = orders if status is None else orders.where(F.col("o_orderstatus") == status)
    return documents(rows, F.expr(padded("o_orderkey")), F.expr(f"concat('编号', {CUST_CODE}, '。')"))


def interrupted_commit(spark, sf_dir):
    """Three runs, with dead ones between them: a commit broken off, an empty marker and half of one."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"))
    target, key = _target(spark, "interrupted"), vault_key(spark, SECRET)
    folder = VaultFolder(spark, f"{target}/vault")

    def run(name: str, docs: DataFrame, vault: VaultFolder = folder) -> None:
        runs.prepare(docs, key, vault, POLICY, name, output=f"{target}/out", bundle=False)

    run("run-1", _code_documents(orders, "F"))
    try:
        run("lost", _code_documents(orders), _Dying(spark, folder.path))
    except ConnectionError:
        pass
    _half_made(folder, 2, "")
    run("run-2", _code_documents(orders, "O"))
    _half_made(folder, 3, '{"base": 1, "fold')
    run("run-3", _code_documents(orders))
    entries = folder.load().token_runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("entries"))
    released = spark.read.parquet(f"{target}/out/documents").groupBy("run_id").agg(F.count(F.lit(1)).alias("documents"))
    return entries.join(released, "run_id", "full")


def purge_folder(spark, sf_dir):
    """Runs purged from a vault folder, before and after it is written in one piece: what goes, what is left, the last number."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"))
    folder, out = VaultFolder(spark, _target(spark, "purged")), []

    def add(run_id: str, status: str) -> None:
        state = folder.load()
        folder.append(state, _assigned(spark, sf_dir, detect(_code_documents(orders, status), POLICY), state, run_id))

    def told(step: str, removed: int) -> None:
        state = folder.load()
        entries = state.token_map.agg(F.count(F.lit(1)).alias("entries"))
        used = state.token_runs.agg(F.count_distinct("run_id").alias("runs"))
        last = state.counters.agg(F.max("last_no").alias("last_no"))
        row = entries.join(used).join(last)  # one row each
        out.append(row.select(F.lit(step).alias("step"), F.lit(removed).cast("long").alias("removed"), "entries", "runs", "last_no"))

    for run_id, status in (("run-1", "F"), ("run-2", "O"), ("run-3", "P")):
        add(run_id, status)
    told("purged run-2", folder.purge("run-2"))
    folder.compact()
    told("compacted", 0)
    add("run-4", "O")
    told("purged run-1", folder.purge("run-1"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def policy_from_file(spark, sf_dir):
    """Findings by action under a policy read from YAML, and under the built-in one with its term lists."""
    target = _target(spark, "policies")
    lines = "default_action: redact\nfail_on: [DATE]\nentities:\n  EMAIL: generalize\n  PHONE: mask\n"
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(f"{target}/own.yaml", lineSep="\n")
    own = load_policy(spark, f"{target}/own.yaml")
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    names.write.csv(f"{target}/{STRICT_DICTIONARIES[0][0]}", header=True)
    built_in = load_policy(spark, "default")
    terms = read_terms(spark, built_in, target)
    named = detect(add_term_spans(_ordered_by(spark, sf_dir), terms, built_in), built_in, terms="_terms")
    found = findings(detect(_notes(spark, sf_dir), own)).withColumn("policy", F.lit(own.name))
    found = found.unionByName(findings(named).withColumn("policy", F.lit(built_in.name)))
    return found.groupBy("policy", "entity_type", "action").agg(F.count(F.lit(1)).alias("findings"))


def split_secrets(spark, sf_dir):
    """Keys that begin in one turn of a conversation and end in a later one."""
    opening = "concat(text, chr(10), '-----BEGIN PRIVATE KEY-----', chr(10), turn)"
    closing = "concat(turn, chr(10), '-----END PRIVATE KEY-----', chr(10), text)"
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", f"case turn % 4 when 0 then {opening} when 2 then {closing} else text end as text"
    )
    found = findings(detect(joined_documents(turns, "conv_id", ["turn"], "text"), POLICY, rules_for("PRIVATE_KEY")))
    return found.groupBy("source_id").agg(F.count(F.lit(1)).alias("secrets"), F.sum(F.length("value")).alias("chars"))


def second_pass(spark, sf_dir):
    """Secrets that only the finished sections show: here in the heading."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    name = F.expr("concat('orders/', o_orderkey, case when o_orderstatus = 'P' then concat('/pwd=', md5(cast(o_orderkey as string))) else '' end)")
    sanitized = redact(detect(documents(orders, name, F.expr("concat('total ', o_orderstatus)")), POLICY))
    return gate.leaks(sanitized, POLICY).select(
        "source_id", "section", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"),
        "entity_type", "value",
    )


def second_pass_joined(spark, sf_dir):
    """Secrets that only the joined bundle shows: key blocks over many sections, a cookie that meets the next heading."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    text = "case o_orderstatus when 'O' then 'k -----BEGIN PRIVATE KEY----- m' when 'F' then 'x -----END PRIVATE KEY-----' else 'Cookie:' end"
    sanitized = redact(detect(documents(orders, F.expr(padded("o_orderkey")), F.expr(text)), POLICY))
    return gate.crossing_leaks(sanitized, POLICY).select(
        "section", "until", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"),
        "entity_type", "detector",
    )


def report_findings(spark, sf_dir):
    report = audit.report_findings(findings(detect(_documents(spark, sf_dir), POLICY)))
    return report.select(
        "entity_type", "action", "source_id", "confidence", "detector", "risk",
        F.col("locator.kind").alias("kind"),
        F.col("locator.start").cast("bigint").alias("start_pos"),
        F.col("locator.end").cast("bigint").alias("end_pos"),
    )


def report_summary(spark, sf_dir):
    run = runs.scan(_documents(spark, sf_dir), run_id="run-1")
    return run.summary.select(
        "run_id", "blocked", "finding_count",
        F.to_json("counts_by_entity").alias("counts_by_entity"), F.to_json("counts_by_action").alias("counts_by_action"),
    )


def counts_by_action(spark, sf_dir):
    return audit.counts_by_action(findings(detect(_notes(spark, sf_dir), POLICY)))


def grouped_counts(spark, sf_dir):
    return audit.counts_grouped(findings(detect(_notes(spark, sf_dir), POLICY)))


def findings_per_document(spark, sf_dir):
    return audit.findings_per_document(detect(_documents(spark, sf_dir), POLICY))


def document_results(spark, sf_dir):
    """Outcome of every document, unreadable ones included."""
    detected = detect(_classified_documents(spark, sf_dir), POLICY)
    return audit.document_results(detected, "prepared", audit.output_name(F.col("source_id")))


def bundle_sections(spark, sf_dir):
    sanitized = redact(detect(_documents(spark, sf_dir), POLICY))
    return audit.bundle_sections(sanitized)


# --- sources ----------------------------------------------------------------


def _as_files(spark, sf_dir) -> DataFrame:
    """Documents as file contents; their language picks the kind of file."""
    path = "concat('/data/', source, '/', doc_id, case lang when 'en' then '.md' when 'fr' then '.TXT' when 'de' then '.pdf' else '.bin' end)"
    content = "encode(replace(text, chr(10), concat(chr(13), chr(10))), 'UTF-8')"
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return rows.selectExpr(f"{path} as path", f"{content} as content")


def _classified_documents(spark, sf_dir) -> DataFrame:
    return files.extract(_as_files(spark, sf_dir), "/data")


def extract_text_files(spark, sf_dir):
    return _classified_documents(spark, sf_dir).select("source_id", "text", "status", "media_type", "error_code")


def content_hash(spark, sf_dir):
    return _classified_documents(spark, sf_dir).select("path", "sha256")


def json_canonical(spark, sf_dir):
    path, content = "concat('/events/', event_id, '.json')", "encode(concat('{\"type\":\"', event_type, '\", \"props\": ', props, '}'), 'UTF-8')"
    rows = table(spark, sf_dir, "events").selectExpr(f"{path} as path", f"{content} as content")
    return files.extract(rows, "/events").select("source_id", "text", "status")


def delimited_flatten(spark, sf_dir):
    """A small CSV file per customer, with a quoted cell."""
    content = "concat('key,name,note', chr(13), chr(10), c_custkey, ',', c_name, ',\"', c_mktsegment, ', ', '\"\"', c_nationkey, '\"\"\"', chr(10))"
    rows = table(spark, sf_dir, "customer").selectExpr(
        "concat('/crm/', c_custkey, '.csv') as path", f"encode({content}, 'UTF-8') as content"
    )
    return files.extract(rows, "/crm").select("source_id", "text", "media_type")


def jsonl_lines(spark, sf_dir):
    """Files of JSON lines with blank lines between; every fiftieth is empty."""
    content = "if(event_id % 50 = 0, concat(' ', chr(10)), concat(props, chr(13), chr(10), chr(10), '\"', event_type, '\"', chr(10)))"
    rows = table(spark, sf_dir, "events").selectExpr(
        "concat('/events/', event_id, '.jsonl') as path", f"encode({content}, 'UTF-8') as content"
    )
    return files.extract(rows, "/events").select("source_id", "text", "status", "error_code")


def jsonl_ranges(spark, sf_dir):
    """All events in one file of JSON lines, read range by range: the number of each line and its text."""
    events = table(spark, sf_dir, "events").orderBy("event_id")
    lines = events.select(F.format_string('{"t": "%s", "id": %d}', "event_type", "event_id").alias("value"))
    target = _target(spark, "lines")
    files.write_named(lines, f"{target}/events.jsonl")
    docs = files.read_documents(spark, [target], target, split=RANGE_BYTES)
    number = F.regexp_extract("source_id", ":([0-9]+)$", 1).cast("bigint")
    return docs.select(number.alias("line_no"), "text", "status", "error_code")


def delimited_ranges(spark, sf_dir):
    """All customers in one CSV file with line ends in quoted cells, read range by range: its lines and how often each occurs."""
    rows = table(spark, sf_dir, "customer").orderBy("c_custkey")
    quoted = "concat(c_mktsegment, chr(10), 'say \"\"', c_nationkey, '\"\"')"
    cells = F.expr(f"concat(c_custkey, ',', chr(34), {quoted}, chr(34), ',', c_name)")
    target = _target(spark, "records")
    files.write_named(rows.select(cells.alias("value")), f"{target}/customers.csv")
    docs = files.read_documents(spark, [target], target, split=RANGE_BYTES)
    lines = docs.select("status", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("status", "line").agg(F.count(F.lit(1)).alias("lines"))


#: Bytes of a range where a given table is one file; such a file is shorter than what is cut by default.
RANGE_BYTES = 1 << 14


def read_manifest(spark, sf_dir):
    """A file per customer, written by tasks: in folders asked for twice, with names that Spark leaves out, hidden, empty, not UTF-8."""
    target = _target(spark, "manifest")
    kinds = (
        ("concat('plain/', c_nationkey, '/n', c_custkey, '.txt')", "concat(c_name, chr(13), chr(10))"),
        ("concat('_under/deep/', c_nationkey, '/n', c_custkey, '.md')", "c_name"),
        ("concat('.hidden/n', c_custkey, '.txt')", "c_name"),
        ("concat('n', c_custkey, '.tsv')", "concat('a', chr(9), 'b', chr(13), chr(10), c_name, chr(9))"),
        ("concat('_n', c_custkey, '.txt')", "concat('国家', c_name)"),
        ("concat('n', c_custkey, '.jsonl')", "''"),
    )
    choose = lambda at: " ".join(f"when {n} then {kind[at]}" for n, kind in enumerate(kinds))
    rows = spread(table(spark, sf_dir, "customer")).selectExpr(
        f"concat('{target}/', case c_custkey % 6 {choose(0)} end) as path", f"case c_custkey % 6 {choose(1)} end as text"
    )
    files.write_contents(rows, "gb18030")
    docs = files.read_documents(spark, [target, f"{target}/plain", f"{target}/.hidden/n2.txt"], target)
    return docs.select("source_id", "text", "status", "error_code")


def read_written_files(spark, sf_dir):
    """Customers written as CSV files by Spark and read back as documents."""
    folder = staged(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "crm").inputFiles()[0].rsplit("/", 1)[0]
    target = f"{folder}-csv"
    spark.read.parquet(folder).write.csv(target)
    docs = files.read_documents(spark, [target], target)
    lines = docs.select("status", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line != ''")


# --- sinks and stores, written to the shared folder and read back ------------


def _target(spark, label: str) -> str:
    return f"{shared_folder(spark)}/veilframe-{label}-{uuid.uuid4().hex}"


def written_documents(spark, sf_dir):
    target = _target(spark, "documents")
    audit.write_documents(redact(detect(_documents(spark, sf_dir), POLICY)), target, "run-1")
    return spark.read.parquet(target).select("source_id", "output_name", "text", "run_id")


def written_bundle(spark, sf_dir):
    """Lines of the written bundle and how often each occurs."""
    target = _target(spark, "bundle")
    audit.write_bundle(redact(detect(_documents(spark, sf_dir), POLICY)), target)
    lines = spark.read.option("lineSep", "\n").text(f"{target}/part=*")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("lines"))


def bundle_order(spark, sf_dir):
    """The place of each document in the written bundle: its files by name, sections as they stand."""
    target = _target(spark, "bundle")
    audit.write_bundle(redact(detect(_documents(spark, sf_dir), POLICY)), target)
    parts = spark.read.text(f"{target}/part=*", wholetext=True).select(
        F.input_file_name().alias("file"), F.regexp_extract_all("value", F.lit("(?m)^## Source: (.*)$"), F.lit(1)).alias("named")
    )
    parts = staged(parts, "parts")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts = parts.withColumn("before", F.coalesce(F.sum(F.size("named")).over(earlier), F.lit(0)))
    return parts.select("before", F.posexplode("named").alias("pos", "source_id")).select(
        (F.col("before") + F.col("pos") + 1).alias("place"), "source_id"
    )


def report_files(spark, sf_dir):
    """Documents and outputs of a written report, and its summary, read back."""
    target = _target(spark, "report")
    runs.scan(_classified_documents(spark, sf_dir), POLICY, run_id="run-1").write_report(target)
    docs = spark.read.schema("source_id string, status string, media_type string, sha256 string, error_code string").json(
        f"{target}/run-1/documents"
    )
    outputs = spark.read.schema("source_id string, status string, finding_count bigint").json(f"{target}/run-1/outputs")
    summary = spark.read.schema("run_id string, blocked boolean, finding_count bigint").json(f"{target}/run-1/summary")
    total = summary.select("run_id", "blocked", F.col("finding_count").alias("findings"))
    both = docs.join(outputs.withColumnRenamed("status", "outcome"), "source_id", "full")
    return both.withColumn("run_id", F.lit("run-1")).join(F.broadcast(total), "run_id")  # the summary is one row


def written_report(spark, sf_dir):
    target = _target(spark, "report")
    runs.scan(_documents(spark, sf_dir), run_id="run-1").write_report(target)
    schema = "entity_type string, action string, source_id string, start bigint, end bigint, confidence double, risk string"
    return spark.read.schema(schema).json(f"{target}/run-1/findings").select(
        "entity_type", "action", "source_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "confidence", "risk"
    )


def vault_folder(spark, sf_dir):
    """Two committed runs, opened again from the folder."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"))
    folder = VaultFolder(spark, _target(spark, "vault"))
    for run_id, rows in (("run-1", orders.where("o_orderstatus = 'F'")), ("run-2", orders)):
        state = folder.load()
        docs = documents(rows, F.expr(padded("o_orderkey")), F.expr(f"concat('编号', {CUST_CODE}, '。')"))
        folder.append(state, _assigned(spark, sf_dir, detect(docs, POLICY), state, run_id))
    key = vault_key(spark, SECRET)
    value = tokens.decrypt(F.col("value_enc"), F.col("identity"), key)
    return folder.load().token_map.select("token", value.alias("value"))


def terms_from_files(spark, sf_dir):
    """Product names written as a term list and read by a policy."""
    target = _target(spark, "terms")
    table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_name").alias("name")).distinct().write.csv(target, header=True)
    policy = Policy(dictionaries=((target, "PROJECT"),))
    return read_terms(spark, policy).select("term", "entity_type")


def queries() -> dict[str, Query]:
    named = {f"detect_{name}": _carrier_query(name) for name in CARRIERS}
    listed = (
        detect_email, detect_bank_card, scan_every_text, counts_by_entity, dictionary_scan, dictionary_join,
        dictionary_products, resolve_overlaps, policy_actions, redact_notes, redact_documents, assign_tokens,
        assign_tokens_again, run_membership, purge_first_run, rekey_vault, vault_status, keyed_identity, tokenize_notes,
        prepare_notes, restore_notes, gate_documents, gate_texts, gate_run, second_pass, second_pass_joined, report_findings, report_summary,
        counts_by_action, grouped_counts, findings_per_document, document_results, bundle_sections, extract_text_files,
        content_hash, json_canonical, delimited_flatten, read_written_files, written_documents, written_bundle, written_report,
        vault_folder, terms_from_files, restore_popular, gate_unreadable, blocked_writes_nothing, clashing_runs, interrupted_commit, purge_folder,
        policy_from_file, split_secrets, jsonl_lines, read_manifest, bundle_order, report_files,
        jsonl_ranges, delimited_ranges,
    )
    named.update({query.__name__: query for query in listed})
    named["bucket_money"] = _redacted_carrier("money")
    named["month_dates"] = _redacted_carrier("date")
    return named
