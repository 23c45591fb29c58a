"""What takes the place of a span, and how it gets into the text (SQL text)."""

from __future__ import annotations

import sys
import unicodedata

from veilframe.functions.patterns import sql_regex, sql_string

DEFAULT_PREFIX = "VEIL"
CHUNK = 4096

# --- fixed values: amounts and names of the buckets -------------------------
BUCKETS = ((1_000, "LT_1K"), (10_000, "1K_10K"), (100_000, "10K_100K"), (1_000_000, "100K_1M"))
TOP_BUCKET = "GT_1M"
NO_BUCKET = "BUCKET"
NO_MONTH = "MONTH"

DIGITS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in DIGITS)


def month_sql(value: str) -> str:
    """``YYYY-MM`` of the first year and month in a value, or ``MONTH``."""
    pattern = sql_regex(r"((?:19|20)\d{2})[年/-](1[0-2]|0?[1-9])")
    year, month = (f"regexp_extract({value}, {pattern}, {group})" for group in (1, 2))
    return f"if({year} = '', '{NO_MONTH}', concat({year}, '-', lpad({month}, 2, '0')))"


def bucket_sql(value: str) -> str:
    """The bucket of an amount; 万 counts in ten thousands."""
    digits = f"regexp_replace({value}, {sql_regex('[^' + chr(92) + 'd.]')}, '')"
    plain = f"translate({digits}, '{DIGITS}', '{DIGIT_VALUES}')"
    amount = f"try_cast({plain} as double) * if(contains({value}, '万'), 10000D, 1D)"
    tests = " ".join(f"when a < {limit} then '{name}'" for limit, name in BUCKETS)
    return f"transform(array({amount}), a -> case when a is null then '{NO_BUCKET}' {tests} else '{TOP_BUCKET}' end)[0]"


def placeholder_sql(span: str, prefix: str = DEFAULT_PREFIX) -> str:
    """The replacement of a span that needs no token."""
    head = sql_string(f"[{prefix}_")

    def plain(ending: str) -> str:
        return f"concat({head}, {span}.entity_type, '_{ending}]')"

    return f"""case {span}.action
        when 'mask' then {plain('MASKED')}
        when 'redact' then {plain('REDACTED')}
        when 'generalize' then {plain('GENERALIZED')}
        when 'month_only' then concat({head}, 'DATE_', {month_sql(span + '.value')}, ']')
        when 'bucket' then concat({head}, 'MONEY_', {bucket_sql(span + '.value')}, ']')
        else {plain('REPLACED')} end"""


def token_sql(entity: str, number: str, prefix: str = DEFAULT_PREFIX) -> str:
    return f"concat({sql_string(f'[{prefix}_')}, {entity}, '_', format_string('%04d', {number}), ']')"


def token_pattern(prefix: str = DEFAULT_PREFIX) -> str:
    """Every text that can be a token."""
    return rf"\[\Q{prefix}\E_[^\[\]]+_[0-9]{{4,}}\]"


def gaps_sql(text: str, spans: str) -> str:
    """What stands before, between and behind the spans (by name; disjoint, in text order).

    ``substring`` counts code points from the front, so cutting a long text at
    many places would read its front again for each of them.  A long text is
    first cut into chunks and every piece comes from the chunks that it touches.
    """

    def cut(piece) -> str:
        before = f"if(i = 0, 0, {spans}[i - 1].end)"
        behind = f"transform(array(coalesce({spans}[size({spans}) - 1].end, 0)), b -> {piece('b', f'length({text})')})"
        inner = f"transform({spans}, (s, i) -> transform(array({before}), b -> {piece('b', 's.start')})[0])"
        return f"concat({inner}, {behind})"

    short = cut(lambda start, end: f"substring({text}, {start} + 1, {end} - {start})")
    long = cut(
        lambda start, end: f"substring(array_join(slice(chunks, {start} div {CHUNK} + 1, "
        f"{end} div {CHUNK} - {start} div {CHUNK} + 1), ''), {start} % {CHUNK} + 1, {end} - {start})"
    )
    chunks = f"array(regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0))"
    return f"if(length({text}) <= {CHUNK}, {short}, transform({chunks}, chunks -> {long})[0])"


def woven_sql(gaps: str, replacements: str) -> str:
    """One text of gaps and what is to stand between them."""
    return f"array_join(zip_with({gaps}, {replacements}, (gap, put) -> concat(gap, coalesce(put, ''))), '')"


def splice_sql(text: str, spans: str, replacements: str) -> str:
    """Put replacements in the place of spans (disjoint, in text order)."""
    return f"if(size({spans}) = 0, {text}, {woven_sql(gaps_sql(text, spans), replacements)})"
