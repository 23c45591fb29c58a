"""Detection rules as data.

A rule names the entity it finds, the detector that reports it, its pattern
and its confidence.  Patterns are written in plain notation (``\\b``, ``\\d``,
``\\s`` with Unicode meaning); :func:`veilframe.functions.patterns.spark_regex`
gives the form that Spark's JVM regex functions evaluate with that meaning.

``hints``, ``probe`` and ``sign`` are necessary conditions that are cheaper than the
pattern: a text that holds none of the hints, or does not match the probe,
cannot match the rule.  ``needs`` is a class of which every match holds a
character; many rules share one, and most prose holds none of it.  ``first`` is
a class of all characters a match can start with.  They only save time and
never change a result.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: confidences, names and patterns of the detectors ---------

PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----"
JWT = r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"
OPENAI_KEY = r"\bsk-(?:proj-|test_|live_)?[A-Za-z0-9_-]{24,}\b"
AWS_KEY = r"\bAKIA[0-9A-Z]{16}\b"
GITHUB_TOKEN = r"\b(?:ghp|gho|ghu|ghs)_[A-Za-z0-9_]{24,}\b"
COOKIE = r"\b(?:set-cookie|cookie)\s*[:=]\s*[^;\n]{12,}"
PASSWORD = r"\b(?:password|passwd|pwd|secret)\s*[:=]\s*['\"]?[^'\"\s]{8,}"
EMAIL = r"\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
ID_CARD = (
    r"(?<![0-9A-Za-z])\d{6}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])"
    r"(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx](?![0-9A-Za-z])"
)
BANK_CARD = r"(?<!\d)(?:\d[ -]?){15,19}(?!\d)"
USCC = r"(?<![0-9A-Z])[0-9A-Z]{18}(?![0-9A-Z])"
CONTRACT_ID = r"(?<![A-Za-z0-9])(?:HT|XS|NDA|CDA|PO|SO)-?\d{4}[-A-Z0-9]{3,}(?![A-Za-z0-9])"
# Each of these names ends with one of four pairs of letters (the long s folds to s), whatever stands before it.
CONTRACT_SIGN = r"(?:[Hh][Tt]|[Xx][Ssſ]|[Dd][Aa]|[PpSsſ][Oo])-?\d{4}"
CUSTOMER = r"(?<![A-Za-z0-9])CUST-\d{4}-\d{3,}(?![A-Za-z0-9])"
SAMPLE_ID = r"(?<![A-Za-z0-9])SAMPLE-\d{8}-[A-Z]\d{2,}(?![A-Za-z0-9])"
# Behind an amount only its unit can follow, so nothing is given back; and an
# amount without a sign before it is looked for from its first digit on.
MONEY = (
    r"(?:人民币|RMB|¥|\$)\s*+\d[\d,]*+(?:\.\d++)?+\s*+(?:元|万元|万|美元|USD)?"
    r"|\d(?<!\d\d)[\d,]*+(?:\.\d++)?+\s*+(?:元|万元|万|美元|USD)"
)
DATE = (
    r"\b(?:19|20)\d{2}[年/-](?:0?[1-9]|1[0-2])"
    r"(?:[月/-](?:0?[1-9]|[12]\d|3[01])日?)?\b"
)
DATE_SIGN = r"(?:19|20)\d{2}[年/-]0?[1-9]"
ADDRESS_SUFFIXES = ("省", "市", "区", "县", "镇", "街道", "路", "号楼", "园区", "大厦", "基地")
COMMON_PERSONS = ("张三", "李四", "王五", "赵六", "陈七", "刘强", "王芳", "李娜", "张伟")
PERSON_WORDS = ("姓名", "联系人", "负责人", "员工", "代表", "由")
PERSON_CONTEXT = r"(?:姓名|联系人|负责人|员工|代表|由|甲方代表|乙方代表)[:：\s]*([一-龥]{2,4})"
ORG_CONTEXT = (
    r"(?:在|代表|来自|客户|供应商|公司|主体)[:：\s]*"
    r"([一-龥A-Za-z0-9（）()]{2,32}(?:科技|公司|集团|大学|医院|实验室|中心|研究院|有限公司))"
)
ORG_CONTEXT_ENDINGS = ("科技", "公司", "集团", "大学", "医院", "实验室", "中心", "研究院")
ORG_GENERIC = (
    r"[一-龥A-Za-z0-9（）()]{2,36}"
    r"(?:科技有限公司|生物科技有限公司|有限公司|研究中心|实验室|研究院|集团|大学|医院)"
)
ORG_GENERIC_ENDINGS = ("有限公司", "研究中心", "实验室", "研究院", "集团", "大学", "医院")
ORG_MARKERS = ("客户为", "给", "向", "合作单位：", "合作单位:", "代表")

ENTITY_PRIORITY = {"PRIVATE_KEY": 100, "API_KEY": 95, "JWT": 90, "PASSWORD": 85, "COOKIE": 80}
DEFAULT_PRIORITY = 20
DICTIONARY_CONFIDENCE = 0.98
DICTIONARY_DETECTOR = "dictionary"

# --- two rules in a form that runs in linear time on any input --------------
#
# A project code is a letter-led word, hyphen-joined alphanumeric segments and
# a last segment of 2-4 digits.  Repeating the segment group with backtracking
# overflows the JVM stack on long chains, so the rule takes the whole chain
# without backtracking and then keeps the part up to its last numeric segment.
# Only one code can start in a chain, so both forms give the same spans.
PROJECT_CHAIN = (
    r"(?<![A-Za-z0-9])(?:[A-Z][A-Za-z0-9]*|[A-Za-z]+)"
    r"(?:-[A-Za-z0-9]++(?!\d))++(?:-\d{2,4}(?![A-Za-z0-9]))?+"
)
PROJECT_KEEP = r"^[A-Za-z0-9]++-[A-Za-z0-9]++[A-Za-z0-9-]*-\d{2,4}(?![A-Za-z0-9])"
# Whatever is kept lies in a run of letters, digits and hyphens: behind its first letter's segment and one more comes a short number.
PROJECT_SIGN = (
    r"(?<![A-Za-z0-9-])[0-9-]*+[A-Za-z][A-Za-z0-9]*+-++[A-Za-z0-9]++"
    r"[A-Za-z0-9-]*?-\d{2,4}(?![A-Za-z0-9])"
)
# An address is the part of a run of Chinese characters up to its last place
# suffix: take the run once, then cut it.
ADDRESS_RUN = r"[一-龥]{2,}+"
ADDRESS_KEEP = r"^[一-龥]{2,}(?:" + "|".join(ADDRESS_SUFFIXES) + r")"

CJK = r"[一-龥]"
LONG_NUMBER = r"(?:\d[ -]?){11}"


@dataclass(frozen=True)
class Rule:
    """One detector. ``keep`` says which part of a match is the span:
    ``match`` all of it, ``group`` the capture that ends it, ``head`` the part
    matched by ``keep_pattern``, ``tail`` what follows the first marker found."""

    entity: str
    detector: str
    pattern: str
    confidence: float
    risk: str = "medium"
    ignore_case: bool = False
    keep: str = "match"
    keep_pattern: str = ""
    markers: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    folded_hints: tuple[str, ...] = ()
    probe: str = ""
    needs: str = ""
    first: str = ""
    terms: tuple[str, ...] = ()
    sign: str = ""  # found in every text that the rule keeps something of; asked for behind hints and probe
    rare: bool = False  # seldom found where its hints and probe are: ask for a match before working matches out


# --- fixed values: entity, detector and confidence of each rule, in discovery order -----
SECRET_RULES = (
    Rule("PRIVATE_KEY", "private-key", PRIVATE_KEY, 1.0, "critical", hints=("PRIVATE KEY-----",)),
    Rule("JWT", "jwt", JWT, 0.98, "critical", hints=("eyJ",)),
    Rule("API_KEY", "openai-key", OPENAI_KEY, 0.98, "critical", hints=("sk-",)),
    Rule("API_KEY", "aws-key", AWS_KEY, 0.98, "critical", hints=("AKIA",)),
    Rule("API_KEY", "github-token", GITHUB_TOKEN, 0.98, "critical", hints=("ghp_", "gho_", "ghu_", "ghs_")),
    Rule("COOKIE", "cookie", COOKIE, 0.9, "critical", True, folded_hints=("COO",), needs="[:=]", first="[CcSsſ]"),
    Rule("PASSWORD", "password", PASSWORD, 0.9, "critical", True, folded_hints=("PASSW", "PWD", "SECRET"), needs="[:=]", first="[PpSsſ]"),
)

PERSONAL_RULES = (
    Rule("EMAIL", "email", EMAIL, 0.95, hints=("@",), first="[A-Za-z0-9._%+-]"),
    Rule("PHONE", "cn-phone", PHONE, 0.95, probe=LONG_NUMBER, needs=r"\d", first="1"),
    Rule("ID_CARD", "cn-id-card", ID_CARD, 0.95, probe=LONG_NUMBER, rare=True, needs=r"\d", first=r"\d"),
    Rule("BANK_CARD", "bank-card", BANK_CARD, 0.72, probe=LONG_NUMBER, rare=True, needs=r"\d", first=r"\d"),
    Rule("USCC", "cn-uscc", USCC, 0.78, probe=r"[0-9A-Z]{18}", rare=True, first="[0-9A-Z]"),
    Rule("CONTRACT_ID", "contract-id", CONTRACT_ID, 0.86, ignore_case=True, probe=r"\d(?<=[A-Za-zſ-]\d)\d{3}", sign=CONTRACT_SIGN, needs=r"\d", first="[HhXxNnCcPpSsſ]"),
    Rule("CUSTOMER", "customer-id", CUSTOMER, 0.86, ignore_case=True, folded_hints=("CUST-",), needs=r"\d", first="[Cc]"),
    Rule("SAMPLE_ID", "sample-id", SAMPLE_ID, 0.9, ignore_case=True, folded_hints=("SAMPLE-",), needs=r"\d", first="[Ssſ]"),
    Rule("PROJECT", "project-code", PROJECT_CHAIN, 0.82, keep="head", keep_pattern=PROJECT_KEEP, probe=r"-\d{2}", sign=PROJECT_SIGN, needs=r"\d", first="[A-Za-z]"),
    Rule("MONEY", "money", MONEY, 0.86, hints=("人民币", "RMB", "¥", "$", "元", "万", "USD"), needs=r"\d", first=r"[人R¥$\d]"),
    Rule("DATE", "cn-date", DATE, 0.75, probe=r"[12][09]\d{2}[年/-]", sign=DATE_SIGN, needs=r"\d", first="[12]"),
    Rule("ADDRESS", "cn-address", ADDRESS_RUN, 0.7, keep="head", keep_pattern=ADDRESS_KEEP, hints=ADDRESS_SUFFIXES, probe=CJK),
)

NAME_RULES = (
    Rule("PERSON", "cn-person-common", "", 0.88, terms=COMMON_PERSONS, probe=CJK),
    Rule("PERSON", "cn-person-context", PERSON_CONTEXT, 0.84, keep="group", hints=PERSON_WORDS, probe=CJK, rare=True),
    Rule("ORG", "cn-org-context", ORG_CONTEXT, 0.84, keep="group", hints=ORG_CONTEXT_ENDINGS, probe=CJK, rare=True),
    Rule("ORG", "cn-org-generic", ORG_GENERIC, 0.8, keep="tail", markers=ORG_MARKERS, hints=ORG_GENERIC_ENDINGS, probe=CJK),
)

# Discovery order of the built-in detectors; dictionary terms come between
# the personal and the name rules.  The order is the last tie-break between
# overlapping spans.
BUILTIN_RULES = SECRET_RULES + PERSONAL_RULES + NAME_RULES


def rules_for(*entities: str) -> tuple[Rule, ...]:
    """The built-in rules of some entity types, in discovery order."""
    return tuple(rule for rule in BUILTIN_RULES if rule.entity in entities)


def rules_named(*detectors: str) -> tuple[Rule, ...]:
    """The built-in rules of some detectors, in discovery order."""
    return tuple(rule for rule in BUILTIN_RULES if rule.detector in detectors)
