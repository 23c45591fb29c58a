"""Sensitive-data detection, sanitizing and restoring over tables of documents."""

from veilframe.functions.crypto import vault_key
from veilframe.plans.runs import RunResult, prepare, restore, scan
from veilframe.sources.policies import Policy, load_policy
from veilframe.sources.tables import documents
from veilframe.sources.vaults import VaultFolder

__all__ = ["Policy", "RunResult", "VaultFolder", "documents", "load_policy", "prepare", "restore", "scan", "vault_key"]
