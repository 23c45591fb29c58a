"""Detection: a text column to an array of spans, one row per document."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.patterns import column_name, sql_regex
from veilframe.functions.rules import BUILTIN_RULES, Rule
from veilframe.functions.spans import NO_SPANS, cut_sql, evaluated_once, found_sql, has_hint, has_nul, matches, possible, probed, text_of
from veilframe.operators.resolve import resolve_sql
from veilframe.sources.policies import Policy

SPANS = "spans"


def _with_checks(docs: DataFrame, rules: tuple[Rule, ...], text: str) -> tuple[DataFrame, dict[Rule, str]]:
    """Add one boolean column per cheap check that several rules share.

    The text is scanned for a probe once, however many rules wait for it, and
    for none of those whose class of characters (``needs``) it does not hold.
    """
    needs = {rule.needs: f"_need_{n}" for n, rule in enumerate(rules) if rule.needs}
    docs = docs.selectExpr("*", *(f"{probed(text_of(text), chars)} as {name}" for chars, name in needs.items()))
    uses = Counter((rule.needs, rule.probe) for rule in rules if rule.probe)
    shared = {both: f"_probe_{n}" for n, both in enumerate(uses) if uses[both] > 1}
    added = [f"{has_nul(text_of(text))} as _nul"]
    for (chars, probe), name in shared.items():
        test = probed(text_of(text), probe)
        added.append(f"{needs[chars]} and {test} as {name}" if chars else f"{test} as {name}")
    checks: dict[Rule, str] = {}
    for n, rule in enumerate(rules):
        if (rule.needs, rule.probe) in shared:
            checks[rule] = f"({shared[rule.needs, rule.probe]} and {has_hint(text_of(text), rule)})"
        elif rule.folded_hints:  # all of these share one folding of the text
            added.append(f"{possible(text_of(text), rule, needs.get(rule.needs, ''))} as _hint_{n}")
            checks[rule] = f"_hint_{n}"
        else:
            checks[rule] = possible(text_of(text), rule, needs.get(rule.needs, ""))
    return docs.selectExpr("*", *added), checks


def _found(docs: DataFrame, policy: Policy, rules: tuple[Rule, ...], text: str, terms: str | None):
    checked, checks = _with_checks(docs, rules, text)
    actions = {rule.entity: policy.action_for(rule.entity) for rule in rules}
    cuts = {rule: f"_cut_{n}" for n, rule in enumerate(rules) if not rule.terms}
    checked = checked.selectExpr("*", *(f"{cut_sql(rule, text_of(text), checks[rule], '_nul')} as {name}" for rule, name in cuts.items()))
    found = found_sql(text_of(text), rules, checks, actions, "_nul", cuts)
    if terms:
        found = f"concat({found}, coalesce({column_name(terms)}, array()))"
    return checked, found


def found_spans(
    docs: DataFrame,
    policy: Policy,
    rules: tuple[Rule, ...] = BUILTIN_RULES,
    text: str = "text",
    terms: str | None = None,
    output: str = "found",
) -> DataFrame:
    """Add all spans of the rules, overlapping ones too.

    ``terms`` names a column that already holds dictionary spans.
    """
    checked, found = _found(docs, policy, rules, text, terms)
    return checked.select(*map(F.col, map(column_name, docs.columns)), F.expr(evaluated_once(found, NO_SPANS)).alias(output))


def detect(
    docs: DataFrame,
    policy: Policy,
    rules: tuple[Rule, ...] = BUILTIN_RULES,
    text: str = "text",
    terms: str | None = None,
) -> DataFrame:
    """Add ``spans``: the accepted, non-overlapping spans in text order."""
    found = found_spans(docs, policy, rules, text, terms, "_found")
    kept = [column_name(name) for name in docs.columns]
    return found.selectExpr(*kept, f"{evaluated_once(resolve_sql('_found'), NO_SPANS)} as {SPANS}")


def findings(detected: DataFrame, key: str = "source_id") -> DataFrame:
    """One row per accepted span.  Holds the raw ``value``: not for reports."""
    return detected.select(F.col(key), F.inline(SPANS)).drop("priority", "place")


def fail_rules(policy: Policy, rules: tuple[Rule, ...] = BUILTIN_RULES) -> tuple[Rule, ...]:
    """Rules whose entity the policy does not let through."""
    return tuple(rule for rule in rules if policy.action_for(rule.entity) == "fail")


def has_fail(policy: Policy, rules: tuple[Rule, ...] = BUILTIN_RULES, text: str = "text") -> Column:
    """True for a text with a finding that fails the policy.

    A fail finding outranks every other kind, so one exists among the accepted
    spans exactly when a fail rule finds something; for a rule that keeps its
    whole match no span has to be worked out.
    """
    tests = []
    for rule in fail_rules(policy, rules):
        check = possible(text_of(text), rule)
        if rule.keep == "match" and not rule.terms:
            tests.append(f"({check} and {matches(text_of(text), rule)})")
        else:
            tests.append(f"size({found_sql(text_of(text), (rule,), {rule: check}, {rule.entity: 'fail'})}) > 0")
    return F.expr(" or ".join(tests) if tests else "false")
