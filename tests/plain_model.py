"""A plain Python model of detection, for comparison on small texts.

It works on single strings with the standard ``re`` module and the greedy
choice as it is defined, without clusters, probes or Spark.
"""

import re

from veilframe.functions import rules as R

# --- fixed values: the patterns that the library writes in another form -----
MONEY = (
    r"(?:人民币|RMB|¥|\$)\s*\d[\d,]*(?:\.\d+)?\s*(?:元|万元|万|美元|USD)?"
    r"|\d[\d,]*(?:\.\d+)?\s*(?:元|万元|万|美元|USD)"
)
PROJECT = (
    r"(?<![A-Za-z0-9])(?:[A-Z][A-Za-z0-9]*|[A-Za-z]+)-[A-Za-z0-9]+"
    r"(?:-[A-Za-z0-9]+)*-\d{2,4}(?![A-Za-z0-9])"
)
ADDRESS = r"[一-龥]{2,}(?:省|市|区|县|镇|街道|路|号楼|园区|大厦|基地)"


def rule_spans(text, rule):
    if rule.terms:
        spans = []
        for term in rule.terms:
            spans += [(m.start(), m.end()) for m in re.finditer(re.escape(term), text)]
        return spans
    pattern = {"project-code": PROJECT, "cn-address": ADDRESS, "money": MONEY}.get(rule.detector, rule.pattern)
    spans = []
    for match in re.finditer(pattern, text, re.IGNORECASE if rule.ignore_case else 0):
        start, end = match.span(1 if rule.keep == "group" else 0)
        if rule.keep == "tail":
            found = [marker for marker in rule.markers if marker in text[start:end]]
            if found:
                start += text[start:end].rindex(found[0]) + len(found[0])
        if end > start:
            spans.append((start, end))
    return spans


def raw(text, policy, terms=()):
    """(start, end, entity, action, confidence, priority, detector) in discovery order."""
    out = []

    def add(spans, entity, confidence, detector):
        priority = R.ENTITY_PRIORITY.get(entity, R.DEFAULT_PRIORITY)
        out.extend((a, b, entity, policy.action_for(entity), confidence, priority, detector) for a, b in spans)

    for rule in R.SECRET_RULES + R.PERSONAL_RULES:
        add(rule_spans(text, rule), rule.entity, rule.confidence, rule.detector)
    for term, entity in terms:
        add([(m.start(), m.end()) for m in re.finditer(re.escape(term), text)], entity, 0.98, "dictionary")
    for rule in R.NAME_RULES:
        add(rule_spans(text, rule), rule.entity, rule.confidence, rule.detector)
    return out


def accepted(found):
    order = sorted(
        range(len(found)),
        key=lambda n: (found[n][3] != "fail", -found[n][4], found[n][0] - found[n][1], -found[n][5], n),
    )
    taken = []
    for n in order:
        start, end = found[n][:2]
        if end > start and all(end <= other[0] or other[1] <= start for other in taken):
            taken.append(found[n])
    return sorted(taken)


def detect(text, policy, terms=()):
    return [(a, b, entity, action, detector) for a, b, entity, action, _, _, detector in accepted(raw(text, policy, terms))]
