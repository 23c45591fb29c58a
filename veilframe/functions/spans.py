"""Span expressions: text column in, array of spans out, no shuffle.

A span is a struct with code-point offsets (end exclusive).  All spans of a
document stay in one array column of its row, so detection, conflict
resolution and splicing never move the text between executors.

The expressions are built as SQL text: a few dozen rules make one expression,
and one parse of it is far cheaper than thousands of calls into the JVM.
"""

from __future__ import annotations

from veilframe.functions.patterns import column_name, spark_regex, sql_regex, sql_string
from veilframe.functions.rules import BUILTIN_RULES, CJK, DEFAULT_PRIORITY, ENTITY_PRIORITY, NAME_RULES, Rule

SPAN_FIELDS = (
    "start int, end int, entity_type string, action string, confidence double, "
    "priority int, place int, detector string, risk string, value string"
)
SPAN_TYPE = "struct<" + SPAN_FIELDS.replace(" ", ":").replace(",:", ",") + ">"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
BLOCK = 256
NO_SPANS = f"cast(array() as {SPANS_TYPE})"

# Place of a detector in discovery order, the last tie-break of overlaps;
# dictionary terms come before the first name rule.
PLACES = {rule.detector: 2 * n for n, rule in enumerate(BUILTIN_RULES)}
DICTIONARY_PLACE = PLACES[NAME_RULES[0].detector] - 1


def text_of(column: str) -> str:
    return f"coalesce({column_name(column)}, '')"


def evaluated_once(sql: str, empty: str) -> str:
    """An expression that the optimizer leaves where it is.

    A filter on spans, or the one Spark infers for ``inline``, would otherwise be
    moved below the detection by repeating the whole detection inside the filter.
    Naming the task makes the column non-deterministic for the optimizer only:
    the condition never holds.  Filters on other columns belong before detection.
    """
    return f"if(spark_partition_id() < 0, {empty}, {sql})"


def folded(text: str) -> str:
    """Upper-cased text, which also folds the long s; hints hold no letter (i, k)
    with a variant that upper-casing leaves alone."""
    return f"upper({text})"


def has_hint(text: str, rule: Rule) -> str:
    """Whether the text holds one of the rule's hints; true without any."""
    hints = [f"contains({text}, {sql_string(hint)})" for hint in rule.hints]
    hints += [f"contains({folded(text)}, {sql_string(hint)})" for hint in rule.folded_hints]
    return "(" + " or ".join(hints) + ")" if hints else "true"


def probed(text: str, probe: str) -> str:
    """Whether a probe or class occurs; that of Chinese characters only where characters take several bytes."""
    found = f"{text} rlike {sql_regex(probe)}"
    return f"(octet_length({text}) > char_length({text}) and {found})" if probe == CJK else found


def possible(text: str, rule: Rule, needed: str = "") -> str:
    """False only when the rule cannot match the text.  ``needed`` names a column that holds the answer for ``needs``."""
    tests = [needed or probed(text, rule.needs)] if rule.needs else []
    tests += [probed(text, rule.probe)] if rule.probe else []
    return "(" + " and ".join([*tests, has_hint(text, rule)]) + ")"


def matches(text: str, rule: Rule) -> str:
    """Whether the pattern of a rule occurs in the text."""
    return f"({text} rlike {sql_regex(rule.pattern, rule.ignore_case, rule.first)})"


def after_markers(value: str, markers: tuple[str, ...]) -> str:
    """What follows the last copy of the first listed marker that occurs."""
    tests = " ".join(
        f"when contains({value}, {sql_string(m)}) then substring_index({value}, {sql_string(m)}, -1)" for m in markers
    )
    return f"case {tests} else {value} end"


def _kept(rule: Rule, regex: str, hits: str) -> str:
    """The parts of the matches ``hits`` that become spans."""
    return hits if rule.keep == "match" else f"transform({hits}, h -> {_kept_part(rule, regex, 'h')})"


def _kept_part(rule: Rule, regex: str, hit: str) -> str:
    if rule.keep == "group":  # these patterns look at nothing outside their match
        return f"regexp_extract({hit}, {regex}, 1)"
    if rule.keep == "head":
        return f"regexp_extract({hit}, {sql_regex(rule.keep_pattern)}, 0)"
    if rule.keep == "tail":
        return after_markers(hit, rule.markers)
    return hit


def has_nul(text: str) -> str:
    return f"contains({text}, '\\0')"


def cut_sql(rule: Rule, text: str, check: str, nul: str) -> str:
    """The text cut at the matches of a rule: gap, match, gap and so on. Null where the rule cannot match or keeps nothing.

    One search marks the matches with a character that the text does not hold
    and a split at that character gives both.  The rare text with the character
    is searched twice instead: from the end of the last match (``\\G``) the
    shortest gap that a match follows, once for the gaps, once for the matches.
    """
    regex = sql_regex(rule.pattern, rule.ignore_case, rule.first)
    plain = spark_regex(rule.pattern, rule.ignore_case).replace("'", r"\x27")
    marked = f"split(regexp_replace({text}, {regex}, '\\0$0\\0'), '\\0', -1)"
    gaps, hits = (rf"regexp_extract_all({text}, r'(?s)\G(.*?)({plain})', {group})" for group in (1, 2))
    searched = f"concat(flatten(zip_with({gaps}, {hits}, (gap, hit) -> array(gap, hit))), array(''))"
    cut = f"if({nul}, {searched}, {marked})"
    if rule.keep != "match":
        kept = _kept(rule, sql_regex(rule.pattern, rule.ignore_case), "filter(a, (x, i) -> i % 2 = 1)")
        cut = f"transform(array({cut}), a -> if(array_join({kept}, '') = '', null, a))[0]"
    if rule.rare:
        check = f"({check} and {matches(text, rule)})"
    if rule.sign:
        check = f"({check} and {text} rlike {sql_regex(rule.sign)})"
    return f"if({check}, {cut}, null)"


def _named(text: str, rule: Rule) -> str:
    """Whether the text holds a name of a built-in list."""
    return "(" + " or ".join(f"contains({text}, {sql_string(term)})" for term in rule.terms) + ")"


def rule_pieces(rule_id: int, rule: Rule, text: str, check: str, cut: str) -> str:
    """An array with the matches of one rule and the texts between them, empty
    without a match.  A built-in name list gives one entry per name found."""
    if rule.terms:
        names = "array(" + ", ".join(sql_string(term) for term in rule.terms) + ")"
        gaps = rf"split({text}, concat('\\Q', n, '\\E'), -1)"
        parts = f"transform(filter({names}, n -> contains({text}, n)), n -> named_struct('n', n, 'gaps', {gaps}))"
        found = f"transform({parts}, p -> named_struct('gaps', p.gaps, 'hits', array_repeat(p.n, size(p.gaps) - 1)))"
        found, kept = f"if({check}, {found}, array())", "m.hits"
    else:
        found = f"""transform(filter(array({cut}), a -> a is not null and size(a) > 1),
            a -> named_struct('gaps', filter(a, (x, i) -> i % 2 = 0), 'hits', filter(a, (x, i) -> i % 2 = 1)))"""
        kept = _kept(rule, sql_regex(rule.pattern, rule.ignore_case), "m.hits")
    return f"transform({found}, m -> named_struct('rule', {rule_id}, 'gaps', m.gaps, 'hits', m.hits, 'kept', {kept}))"


def blocks_of(array: str) -> str:
    """An array (by name) cut into blocks.

    A fold that grows an array copies it in every step.  Folding block by block,
    with a fold over the blocks for what they hand on, keeps the work in line
    with the number of elements also where a document has very many.
    """
    return f"transform(sequence(0, greatest(size({array}) - 1, 0) div {BLOCK}), b -> slice({array}, b * {BLOCK} + 1, {BLOCK}))"


def offsets_of(piece: str, head: str) -> str:
    """The spans of one entry: running lengths of gaps and matches give the
    offsets.  A part cut at its ``head`` ends early, any other ends its match."""
    pairs = f"""filter(
        zip_with(arrays_zip({piece}.hits, {piece}.kept), {piece}.gaps,
            (p, gap) -> named_struct('gap', gap, 'hit', p.hits, 'kept', p.kept)),
        p -> p.hit is not null)"""
    starts = """aggregate(bs, named_struct('pos', 0, 'out', cast(array() as array<int>)),
        (acc, blk) -> named_struct(
            'pos', acc.pos + aggregate(blk, 0, (n, p) -> n + length(p.gap) + length(p.hit)),
            'out', concat(acc.out, array(acc.pos))),
        acc -> acc.out)"""
    spans = f"""aggregate(
        blk,
        named_struct('pos', pos, 'spans', cast(array() as array<struct<start:int,end:int,rule:int,value:string>>)),
        (acc, p) -> named_struct(
            'pos', acc.pos + length(p.gap) + length(p.hit),
            'spans', if(p.kept = '', acc.spans, concat(acc.spans, array(
                if({head},
                    named_struct(
                        'start', acc.pos + length(p.gap),
                        'end', acc.pos + length(p.gap) + length(p.kept), 'rule', {piece}.rule, 'value', p.kept),
                    named_struct(
                        'start', acc.pos + length(p.gap) + length(p.hit) - length(p.kept),
                        'end', acc.pos + length(p.gap) + length(p.hit), 'rule', {piece}.rule, 'value', p.kept)))))),
        acc -> acc.spans)"""
    many = f"""transform(array({pairs}), ps -> transform(array({blocks_of('ps')}), bs ->
        flatten(zip_with(bs, {starts}, (blk, pos) -> {spans})))[0])[0]"""
    # Most entries have one match, whose place is the length of the gap before it.
    hit, kept, gap = (f"length({piece}.{name}[0])" for name in ("hits", "kept", "gaps"))
    begin = f"{gap} + if({head}, 0, {hit} - {kept})"
    one = f"""array(named_struct('start', {begin}, 'end', {begin} + {kept}, 'rule', {piece}.rule, 'value', {piece}.kept[0]))"""
    return f"if(size({piece}.hits) = 1 and {piece}.kept[0] != '', {one}, {many})"


def _about(n: int, rule: Rule, actions: dict[str, str]) -> dict[str, str]:
    """The fields of a span that its rule gives."""
    return {
        "entity_type": sql_string(rule.entity),
        "action": sql_string(actions[rule.entity]),
        "confidence": f"{rule.confidence}D",
        "priority": str(ENTITY_PRIORITY.get(rule.entity, DEFAULT_PRIORITY)),
        "place": str(PLACES.get(rule.detector, 2 * len(BUILTIN_RULES) + n)),
        "detector": sql_string(rule.detector),
        "risk": sql_string(rule.risk),
    }


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def found_sql(
    text: str,
    rules: tuple[Rule, ...],
    checks: dict[Rule, str],
    actions: dict[str, str],
    nul: str | None = None,
    cuts: dict[Rule, str] | None = None,
) -> str:
    """All spans of the rules, in discovery order, overlapping ones too.

    ``cuts`` names columns with the texts as :func:`cut_sql` cuts them.  Where no rule matches a text more than once,
    its spans then come from plain functions, which Spark compiles; higher-order ones are interpreted.
    """
    nul = nul or has_nul(text)
    if not rules:
        return NO_SPANS
    cut_at = cuts or {rule: cut_sql(rule, text, checks[rule], nul) for rule in rules if not rule.terms}
    pieces = ",\n".join(rule_pieces(n, rule, text, checks[rule], cut_at.get(rule, "")) for n, rule in enumerate(rules))
    heads = [str(n) for n, rule in enumerate(rules) if rule.keep == "head"]
    head = f"r.rule in ({', '.join(heads)})" if heads else "false"
    abouts = [_about(n, rule, actions) for n, rule in enumerate(rules)]
    offsets = offsets_of("r", head)
    fields = {"start": "x.s.start", "end": "x.s.end"} | {name: f"x.about.{name}" for name in abouts[0]} | {"value": "x.s.value"}
    many = f"""transform(
        transform(
            flatten(transform(concat({pieces}), r -> {offsets})),
            s -> named_struct('s', s, 'about', array({", ".join(map(_struct, abouts))})[s.rule])),
        x -> {_struct(fields)})"""
    if cuts is None:
        return many
    tests = [
        f"not ({checks[rule]} and {_named(text, rule)})" if rule.terms else f"({cuts[rule]} is null or size({cuts[rule]}) <= 3)"
        for rule in rules
    ]
    singles = [_single(cuts[rule], rule, about) for rule, about in zip(rules, abouts) if not rule.terms]
    return f"if({' and '.join(tests)}, concat({', '.join([NO_SPANS, *singles])}), {many})"


def _single(cut: str, rule: Rule, about: dict[str, str]) -> str:
    """The span of a rule that matches once, in an array; an empty one if it does not match."""
    kept = _kept_part(rule, sql_regex(rule.pattern, rule.ignore_case), f"{cut}[1]")
    start = f"length({cut}[0])" if rule.keep in ("match", "head") else f"length({cut}[0]) + length({cut}[1]) - length({kept})"
    span = _struct({"start": start, "end": f"{start} + length({kept})"} | about | {"value": kept})
    return f"if({cut} is not null and size({cut}) = 3 and {kept} != '', array({span}), {NO_SPANS})"


def priority_sql(entity: str) -> str:
    tests = " ".join(f"when {sql_string(name)} then {priority}" for name, priority in ENTITY_PRIORITY.items())
    return f"case {entity} {tests} else {DEFAULT_PRIORITY} end"
