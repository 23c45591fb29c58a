"""Detection and the per-document gate on a stream of documents.

Both look at one document at a time, so the batch operators apply unchanged and
keep no state.  Tokens need the vault's numbering and belong to batch runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilframe.functions.rules import BUILTIN_RULES, Rule
from veilframe.operators.detect import detect
from veilframe.operators.gate import with_document_verdict
from veilframe.sources.policies import Policy


def scan_stream(docs: DataFrame, policy: Policy, rules: tuple[Rule, ...] = BUILTIN_RULES) -> DataFrame:
    """Add ``spans`` and ``blocked`` to every document of a stream."""
    return with_document_verdict(detect(docs, policy, rules))
