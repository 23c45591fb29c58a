"""Redaction: accepted spans to replaced text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilframe.functions.patterns import column_name
from veilframe.functions.replacements import DEFAULT_PREFIX, gaps_sql, placeholder_sql, splice_sql, woven_sql
from veilframe.functions.spans import text_of
from veilframe.operators.skew import join_skewed

_OPEN = "filter(spans, s -> s.action != 'fail')"


HAS_TOKENS = "has_tokens"


def needs_tokens() -> Column:
    """Whether a document has a span to tokenize.  A table that holds this as
    ``has_tokens`` and is partitioned by it is read once by the two plans of
    :func:`redact_with_tokens`."""
    return F.expr("exists(spans, s -> s.action = 'tokenize')")


def redact(detected: DataFrame, prefix: str = DEFAULT_PREFIX, text: str = "text") -> DataFrame:
    """Replace ``text`` for documents whose spans need no token. No shuffle."""
    replacements = f"transform(_open, s -> {placeholder_sql('s', prefix)})"
    others = [column_name(name) for name in detected.columns if name != text]
    return detected.selectExpr("*", f"{_OPEN} as _open").selectExpr(
        *others, f"{splice_sql(text_of(text), '_open', replacements)} as {column_name(text)}"
    )


def document_order() -> Column:
    """Documents in path order, folder by folder; rows of tables by their id."""
    return F.replace(F.coalesce("path", "source_id"), F.lit("/"), F.lit("\0"))


def occurrences(detected: DataFrame, order: Column | str = "source_id", key: str = "source_id") -> DataFrame:
    """One row per span to tokenize: ``(key, doc_ord, start, entity_type, value)``."""
    spans = F.expr("filter(spans, s -> s.action = 'tokenize')")
    order = F.col(order) if isinstance(order, str) else order
    rows = detected.select(F.col(key), order.alias("doc_ord"), F.explode(spans).alias("s"))
    return rows.select(key, "doc_ord", "s.start", "s.entity_type", "s.value")


def redact_with_tokens(
    detected: DataFrame,
    tokens: DataFrame,
    prefix: str = DEFAULT_PREFIX,
    text: str = "text",
    key: str = "source_id",
) -> DataFrame:
    """Replace ``text``, taking tokens from ``tokens(entity_type, value, token, uses)``.

    Documents without a span to tokenize never leave their partition.  For the
    others the spans to tokenize go to the tokens and back; the text is shuffled
    once, when the tokens come home to their documents.  ``key`` tells documents apart; every span travels with it, so a
    number takes least.
    """
    needs = F.col(HAS_TOKENS) if HAS_TOKENS in detected.columns else needs_tokens()
    plain = redact(detected.where(~needs), prefix, text)
    marked = detected.where(needs)

    spans = marked.select(F.col(key), F.posexplode(F.expr(_OPEN)).alias("pos", "s")).where("s.action = 'tokenize'")
    # Types, values and keys begin alike; a hash in front spares their sorts most comparisons.
    by = F.xxhash64("entity_type", "value").alias("_hash")
    home = {"_home": f"xxhash64({column_name(key)})"} if detected.schema[key].dataType == StringType() else {}
    homes = [*home, key]
    spans = spans.select(key, *(F.expr(sql).alias(name) for name, sql in home.items()), "pos", "s.entity_type", "s.value").select("*", by)
    # Naming the task keeps the optimizer from asking whether a value is null by decrypting it once more.
    once = tokens.withColumn("value", F.when(F.spark_partition_id() >= 0, F.col("value")))
    looked_up = join_skewed(
        spans, once.select("*", by), ["_hash", "entity_type", "value"], "uses", [key, "pos"], tokens.select("*", by)
    )
    found = looked_up.groupBy(*homes).agg(F.collect_list(F.struct("pos", F.col("token").alias("put"))).alias("_tokens"))
    others = [column_name(name) for name in detected.columns if name != text]
    # Cut the texts before they move, so that no span travels with them.
    fixed = f"""filter(
        transform(_open, (s, i) -> named_struct(
            'pos', i, 'put', if(s.action = 'tokenize', null, {placeholder_sql('s', prefix)}))),
        p -> p.put is not null)"""
    kept = [name for name in others if name != column_name(key)]
    pieces = marked.selectExpr("*", f"{_OPEN} as _open").selectExpr(
        column_name(key), *(f"{sql} as {name}" for name, sql in home.items()), *kept, f"{gaps_sql(text_of(text), '_open')} as _gaps", f"{fixed} as _fixed"
    )
    tokenized = pieces.join(found, homes).selectExpr(
        *others, f"{woven_sql('_gaps', 'sort_array(concat(_fixed, _tokens)).put')} as {column_name(text)}"
    )
    return plain.unionByName(tokenized)
