"""Whole runs: scan, prepare and restore over tables of documents."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.crypto import VaultKey
from veilframe.functions.replacements import DEFAULT_PREFIX
from veilframe.functions.rules import BUILTIN_RULES, Rule
from veilframe.operators import audit, gate, tokens
from veilframe.operators.detect import detect, findings
from veilframe.operators.dictionary import add_term_spans
from veilframe.operators.redact import HAS_TOKENS, document_order, needs_tokens, occurrences, redact_with_tokens
from veilframe.session import sensitive, staged
from veilframe.sources.policies import Policy, load_policy
from veilframe.sources.tables import DOCUMENT_FIELDS, repeated_ids
from veilframe.sources.terms import read_terms
from veilframe.sources.vaults import VaultFolder


@dataclass(frozen=True)
class RunResult:
    """Outcome of a run. ``report``, ``summary``, ``documents`` and ``outputs``
    hold no raw values; ``findings`` looks for them again when it is read, and has
    none for what only the second pass saw."""

    run_id: str
    blocked: bool
    findings: DataFrame
    report: DataFrame
    summary: DataFrame
    documents: DataFrame
    outputs: DataFrame
    sanitized: DataFrame | None = None
    assignment: tokens.Assignment | None = None

    def write_report(self, path: str) -> None:
        audit.write_report(
            path,
            self.run_id,
            {"summary": self.summary, "findings": self.report, "documents": self.documents, "outputs": self.outputs},
        )


def new_run_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S-") + uuid.uuid4().hex[:8]


def _detected(docs: DataFrame, policy: Policy, rules: tuple[Rule, ...], terms: DataFrame | None) -> DataFrame:
    if terms is None:
        return detect(docs, policy, rules)
    return detect(add_term_spans(docs, terms, policy), policy, rules, terms="_terms").drop("_terms")


def _without_values(detected: DataFrame) -> DataFrame:
    """The documents' fields and spans, but neither texts nor raw values."""
    bare = F.transform("spans", lambda span: span.withField("value", F.lit(None).cast("string")))
    return detected.select(*(name for name in DOCUMENT_FIELDS if name not in ("path", "text")), bare.alias("spans"))


def _result(run_id, blocked, public, found, status, output_name=None, leaked=None, **extra) -> RunResult:
    """``public`` has no raw values; ``found`` works them out anew when it is read."""
    told = findings(public)
    if leaked is not None:
        told, found = told.unionByName(leaked), found.unionByName(leaked)
    files = ("source_id", "status", "media_type", "sha256", "error_code", "error_message")
    return RunResult(
        run_id=run_id,
        blocked=blocked,
        findings=found,
        report=audit.report_findings(told),
        summary=audit.summary(told, run_id, blocked),
        documents=public.select(*files),
        outputs=audit.document_results(public, status, output_name),
        **extra,
    )


def scan(
    docs: DataFrame,
    policy: str | dict | Policy = "strict-ai",
    run_id: str | None = None,
    terms: DataFrame | None = None,
    rules: tuple[Rule, ...] = BUILTIN_RULES,
    base: str | None = None,
) -> RunResult:
    """Find what a release of the documents would have to hide.

    One pass over the texts; what it finds is written once, without texts and
    raw values, and verdict, report and counts read that.
    """
    spark = docs.sparkSession
    policy = load_policy(spark, policy)
    if terms is None:
        terms = read_terms(spark, policy, base)
    detected = _detected(docs, policy, rules, terms)
    public = staged(_without_values(detected), "scan")
    blocked = gate.run_verdict(public, for_release=False).first()["blocked"]
    return _result(run_id or new_run_id(), blocked, public, findings(detected), "scanned")


def prepare(
    docs: DataFrame,
    key: VaultKey,
    vault: tokens.Vault | VaultFolder,
    policy: str | dict | Policy = "strict-ai",
    run_id: str | None = None,
    output: str | None = None,
    bundle: bool = True,
    terms: DataFrame | None = None,
    rules: tuple[Rule, ...] = BUILTIN_RULES,
    prefix: str = DEFAULT_PREFIX,
    base: str | None = None,
) -> RunResult:
    """Sanitize the documents, or release nothing.

    A fail finding, an unreadable document or a leak found by the second pass
    blocks the run: no text is written and the vault stays as it is.  Otherwise
    the new tokens go into the vault folder and then the sanitized texts to
    ``output``; a run that finds the vault changed raises before any text is
    written.  Tables with raw values that the run stages are deleted when it ends, whatever its end.
    ``bundle`` also writes the texts as one ordered bundle, for which they have to
    be sorted by source id; the second pass then looks across the borders of its sections, too.
    """
    spark = docs.sparkSession
    policy = load_policy(spark, policy)
    run_id = audit.checked_run_id(run_id or new_run_id())
    if terms is None:
        terms = read_terms(spark, policy, base)
    if not repeated_ids(docs).isEmpty():
        raise ValueError("source ids repeat; a document would replace another")
    state = vault.load() if isinstance(vault, VaultFolder) else vault
    again = _detected(docs, policy, rules, terms)
    found = findings(again)
    with sensitive(spark) as raw:
        raw.add("prepare")
        numbered = again.withColumn(HAS_TOKENS, needs_tokens()).withColumn("_row", F.monotonically_increasing_id())
        detected = staged(numbered, "prepare", HAS_TOKENS)
        public = staged(_without_values(detected), "report")
        if gate.run_verdict(public, for_release=True).first()["blocked"]:
            return _result(run_id, True, public, found, "prepared")

        assignment = tokens.assign_tokens(occurrences(detected, document_order()), state, key, run_id, prefix)
        bare = detected.select("_row", "source_id", "text", "spans", HAS_TOKENS)
        sanitized = redact_with_tokens(bare, assignment.tokens, prefix, key="_row").select("source_id", "text")
        sanitized = staged(sanitized, "sanitized", None, "zstd")
        terms_again = None if terms is None else (lambda sections: add_term_spans(sections, terms, policy))
        leaked = gate.leaks(sanitized, policy, rules, terms_again).drop("section")
        leaked = staged(leaked.withColumn("value", F.lit(None).cast("string")), "leaks")
        if output and bundle and leaked.isEmpty():
            # Texts that are written one behind the other may show what none of them shows alone.
            crossing = gate.crossing_leaks(sanitized, policy, rules).drop("section", "until")
            crossing = crossing.withColumn("source_id", F.lit(gate.BUNDLE_SOURCE)).withColumn("value", F.lit(None).cast("string"))
            leaked = staged(crossing.select(*leaked.columns), "leaks")
        if not leaked.isEmpty():
            raw |= {"sanitized", "borders"}
            return _result(run_id, True, public, found, "prepared", leaked=leaked)

        if isinstance(vault, VaultFolder):
            vault.append(state, assignment)
        name = None
        if output:
            audit.write_documents(sanitized, f"{output}/documents", run_id)
            if bundle:
                audit.write_bundle(sanitized, f"{output}/bundle/run_id={run_id}")
            name = F.concat(F.lit(f"{output}/documents/run_id={run_id}#"), audit.output_name(F.col("source_id")))
        return _result(run_id, False, public, found, "prepared", name, sanitized=sanitized, assignment=assignment)


def restore(
    docs: DataFrame,
    key: VaultKey,
    vault: tokens.Vault | VaultFolder,
    run_id: str = "",
    prefix: str = DEFAULT_PREFIX,
) -> DataFrame:
    """Sanitized texts with the values of a run (all runs if empty) put back."""
    state = vault.load() if isinstance(vault, VaultFolder) else vault
    return tokens.restore(docs, state, key, run_id, prefix)
