"""Plain regex notation to the JVM dialect, with Unicode meaning kept.

The JVM reads ``\\d``, ``\\s`` and ``\\b`` as ASCII unless told otherwise, and
its Unicode flag defines word characters by properties that differ from
"letter, number or underscore".  Spelling the three classes out makes a match
independent of the Java version.
"""

from __future__ import annotations

import re

WORD = r"[A-Za-z0-9_\p{L}\p{N}]"  # the first part only makes plain text faster
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
DIGIT = r"\p{Nd}"
SPACE_CHARS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_WORD_START = re.compile(r"\\b(?:\(\?:)?[A-Za-z0-9]")
_CLASS_OR_ESCAPE = re.compile(r"\[(?:\\.|[^\]\\])*\]|\\[bds]")


def spark_regex(plain: str, ignore_case: bool = False, first: str = "") -> str:
    """The pattern as the JVM regex functions should get it.  ``first`` is a class of all
    characters a match can start with, which rules most places out before the pattern looks behind it."""

    def rewrite(match: re.Match) -> str:
        part = match.group(0)
        if part == r"\b":
            return BOUNDARY
        if part == r"\d":
            return DIGIT
        if part == r"\s":
            return f"[{SPACE_CHARS}]"
        part = part.replace(r"\d", DIGIT).replace(r"\s", SPACE_CHARS)
        if ignore_case:  # an upper-case range alone misses letters folding to lower case
            part = re.sub(r"A-Z(?!a-z)", "A-Za-z", part)
        return part

    start = ""
    if _WORD_START.match(plain):  # before a word character, a boundary is the end of no word
        plain, start = plain[2:], f"(?<!{WORD})"
    ahead = f"(?={_CLASS_OR_ESCAPE.sub(rewrite, first)})" if first else ""
    body = ahead + start + _CLASS_OR_ESCAPE.sub(rewrite, plain)
    return f"(?iu){body}" if ignore_case else body


def sql_string(text: str) -> str:
    """A text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_regex(plain: str, ignore_case: bool = False, first: str = "") -> str:
    """A plain pattern as a SQL string literal in the JVM dialect."""
    return "r'" + spark_regex(plain, ignore_case, first).replace("'", r"\x27") + "'"


def column_name(name: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + name.replace("`", "``") + "`"
