"""Gates: what may leave, for a whole run and for single documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.patterns import sql_regex
from veilframe.functions.rules import BUILTIN_RULES, PRIVATE_KEY, Rule
from veilframe.operators.detect import SPANS, detect, fail_rules, findings
from veilframe.session import staged
from veilframe.sources.policies import Policy

# --- fixed values: error codes that stop a scan, and the bundle's parts -----
OCR_ERRORS = ("ocr_required", "ocr_dependency_missing", "ocr_python_dependency_missing")
BUNDLE_SOURCE = "bundle.md"
BUNDLE_HEADER = "# sanitized bundle"
SECTION_HEADING = "## Source: "

#: Characters on either side of a border between sections in which a match across it is looked for.
HALO = 1024


def fails(spans: str = SPANS) -> Column:
    return F.expr(f"exists({spans}, s -> s.action = 'fail')")


def stopping_error(for_release: bool) -> Column:
    """Whether an unreadable document blocks: any does when output is to be
    released; a scan stops only where image text could not be read."""
    unread = F.col("status") == "error"
    return unread if for_release else unread & F.coalesce(F.col("error_code").isin(*OCR_ERRORS), F.lit(False))


def run_verdict(detected: DataFrame, for_release: bool) -> DataFrame:
    """One row: does anything block the run, and what kind."""
    flags = detected.select(fails().alias("failing"), stopping_error(for_release).alias("unread"))
    return flags.agg(
        F.coalesce(F.bool_or("failing"), F.lit(False)).alias("fail_findings"),
        F.coalesce(F.bool_or("unread"), F.lit(False)).alias("unread_documents"),
    ).select("fail_findings", "unread_documents", (F.col("fail_findings") | F.col("unread_documents")).alias("blocked"))


def with_document_verdict(detected: DataFrame, for_release: bool = True) -> DataFrame:
    """The same verdict for every document on its own, so that one bad row does
    not hold up a table. No shuffle."""
    return detected.withColumn("blocked", fails() | stopping_error(for_release))


def section() -> Column:
    """A document's part of the bundle."""
    return F.concat(F.lit(SECTION_HEADING), F.col("source_id"), F.lit("\n\n"), F.col("text"), F.lit("\n"))


def leaks(
    sanitized: DataFrame, policy: Policy, rules: tuple[Rule, ...] = BUILTIN_RULES, terms=None
) -> DataFrame:
    """Second pass: fail findings in the finished sections, heading included.

    Only rules of failing entities run: fail findings outrank all others, so
    the rest cannot change which of them are accepted.  ``terms`` adds
    dictionary spans to a frame with a text column.
    """
    sections = sanitized.select("source_id", section().alias("text"))
    column = None
    if terms is not None:
        sections = terms(sections)
        column = "_terms"
        sections = sections.withColumn("_terms", F.expr("filter(_terms, s -> s.action = 'fail')"))
    detected = detect(sections, policy, fail_rules(policy, rules), terms=column)
    return (
        findings(detected)
        .withColumn("section", F.col("source_id"))
        .withColumn("source_id", F.lit(BUNDLE_SOURCE))
    )


# --- what only the joined bundle shows -----------------------------------------


def with_previous(rows: DataFrame, order: list[str], values: list[str], label: str) -> DataFrame:
    """Add ``previous``, a struct of ``values`` of the row before in ``order``; null for the first.

    Rows are cut into ranges; each range gets the last row of the one before, so no task sees more than its range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = staged(ranged.select("*", F.spark_partition_id().alias("block")), label)
    lasts = blocks.groupBy("block").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last"))
    # One row per range.
    handed = lasts.select("block", F.lag("last").over(Window.orderBy("block")).alias("handed"))
    inside = Window.partitionBy("block").orderBy(*order)
    own = blocks.withColumn("inside", F.lag(F.struct(*values)).over(inside))
    return own.join(F.broadcast(handed), "block").withColumn("previous", F.coalesce("inside", "handed")).drop("block", "inside", "handed")


def crossing_leaks(
    sanitized: DataFrame, policy: Policy, rules: tuple[Rule, ...] = BUILTIN_RULES, halo: int = HALO
) -> DataFrame:
    """Fail findings that begin in one section of the bundle and end in a later one: ``section``, ``until``, ``start`` (in
    the first section), ``end`` (in the last), ``entity_type``, ``action``, ``confidence``, ``detector``, ``risk``.

    Sections meet in the order of their source ids.  A key block may run over any number of sections: its opening is
    paired with the next closing.  All other rules are looked for in the last and first ``halo`` characters
    around each border, so a match over more than that on either side, or over a whole section, is not seen.
    """
    failing = fail_rules(policy, rules)
    sections = sanitized.select("source_id", section().alias("text"))
    parts = [_across_borders(sections, policy, tuple(rule for rule in failing if rule.pattern != PRIVATE_KEY), halo)]
    parts += [_open_blocks(sections, rule) for rule in failing if rule.pattern == PRIVATE_KEY]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _across_borders(sections: DataFrame, policy: Policy, rules: tuple[Rule, ...], halo: int) -> DataFrame:
    ends = sections.select(
        "source_id", F.substring("text", 1, halo).alias("head"), F.length("text").alias("size"), F.expr(f"right(text, {halo})").alias("tail")
    )
    met = with_previous(ends, ["source_id"], ["source_id", "tail", "size"], "borders").where("previous is not null")
    joints = met.select(
        F.struct(F.col("source_id").alias("until"), "previous").alias("source_id"),
        F.concat("previous.tail", F.lit("\n"), "head").alias("text"),
    )
    found = findings(detect(joints, policy, rules)) if rules else findings(detect(joints.limit(0), policy, ()))
    border = F.length("source_id.previous.tail")
    # Something of both sections, not just the line end between them.
    found = found.where((F.col("start") < border) & (F.col("end") > border + 1))
    return found.select(
        F.col("source_id.previous.source_id").alias("section"),
        F.col("source_id.until").alias("until"),
        (F.col("start") + F.col("source_id.previous.size") - border).cast("int").alias("start"),
        (F.col("end") - border - 1).cast("int").alias("end"),
        "entity_type", "action", "confidence", "detector", "risk",
    )


def _open_blocks(sections: DataFrame, rule: Rule) -> DataFrame:
    opening, closing = rule.pattern.split(r"[\s\S]+?")
    begin, end = sql_regex(opening), sql_regex(closing)
    left_open = sql_regex(rf"{opening}(?![\s\S]+{closing})")
    marked = sections.where(F.expr(f"text rlike {begin} or text rlike {end}"))
    # What stands before the first match, by cutting the text there.
    before = lambda regex: f"length(split(text, {regex}, 2)[0])"
    marked = marked.selectExpr(
        "source_id",
        f"if(text rlike {left_open}, {before(left_open)}, null) as opens",
        f"if(text rlike {end}, {before(end)} + length(regexp_extract(text, {end}, 0)), null) as closes",
    )
    # A section with a closing ends what was open before; whether something is open behind it, it says itself.
    states = with_previous(marked, ["source_id"], ["opens"], "marks")
    was_open = F.coalesce(F.col("previous.opens").isNotNull(), F.lit(False))
    starts = F.col("opens").isNotNull() & (~was_open | F.col("closes").isNotNull())
    events = states.select(
        "source_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(was_open & F.col("closes").isNotNull(), F.struct(F.lit(0).alias("kind"), F.col("closes").alias("at"))),
                    F.when(starts, F.struct(F.lit(1).alias("kind"), F.col("opens").alias("at"))),
                )
            )
        ).alias("event"),
    ).select("source_id", "event.kind", "event.at")
    # Openings and closings alternate.
    closed = with_previous(events, ["source_id", "kind"], ["source_id", "at"], "events").where("kind = 0 and previous is not null")
    return closed.select(
        F.col("previous.source_id").alias("section"),
        F.col("source_id").alias("until"),
        F.col("previous.at").cast("int").alias("start"),
        F.col("at").cast("int").alias("end"),
        F.lit(rule.entity).alias("entity_type"),
        F.lit("fail").alias("action"),
        F.lit(rule.confidence).cast("double").alias("confidence"),
        F.lit(rule.detector).alias("detector"),
        F.lit(rule.risk).alias("risk"),
    )
