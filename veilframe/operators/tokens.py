"""The reversible mapping as tables: assignment, restore, purge, re-key.

``token_map(identity, entity_type, token_no, token, value_enc)`` holds one row
per known value, ``token_runs(identity, run_id)`` says which runs used it and
``counters(entity_type, last_no)`` the last number given out, which never goes
back.  Raw values exist only encrypted.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions.crypto import VaultKey, decrypt, decrypt_or_null, encrypt, identity
from veilframe.functions.patterns import column_name
from veilframe.functions.replacements import DEFAULT_PREFIX, token_pattern, token_sql, woven_sql
from veilframe.functions.spans import text_of
from veilframe.operators.skew import join_skewed
from veilframe.session import sensitive, staged

MAP_SCHEMA = "identity string, entity_type string, token_no bigint, token string, value_enc binary"
RUNS_SCHEMA = "identity string, run_id string"
COUNTERS_SCHEMA = "entity_type string, last_no bigint"


@dataclass(frozen=True)
class Vault:
    """``map_parts`` and ``run_parts`` are the same rows in several tables; a store that lays each out by
    identity gives them, so that lookups leave the rows where they are.  ``made_by`` names, for each of ``map_parts``, the
    run that added its rows; nothing where that is not known."""

    token_map: DataFrame
    token_runs: DataFrame
    counters: DataFrame
    version: int = 0
    map_parts: tuple[DataFrame, ...] = ()
    run_parts: tuple[DataFrame, ...] = ()
    made_by: tuple[str, ...] = ()

    def maps(self) -> tuple[DataFrame, ...]:
        return self.map_parts or (self.token_map,)

    def runs(self) -> tuple[DataFrame, ...]:
        return self.run_parts or (self.token_runs,)

    def makers(self) -> tuple[str, ...]:
        return self.made_by or ("",) * len(self.maps())


def union_of(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def of_run(vault: Vault, run_id: str) -> DataFrame:
    """Identities that a run used."""
    return union_of([part.where(F.col("run_id") == run_id).select("identity") for part in vault.runs()])


def entries_of(vault: Vault, run_id: str) -> DataFrame:
    """What the mapping says about the values that a run used.  Rows that this run added are used by it, so they need not
    meet its identities."""
    mine = of_run(vault, run_id)
    return union_of([
        part if maker == run_id else part.join(mine, "identity", "left_semi")
        for part, maker in zip(vault.maps(), vault.makers())
    ])


def only_used_by(vault: Vault, run_id: str) -> DataFrame:
    """Identities that this run used and no other."""
    mine = of_run(vault, run_id)
    for part in vault.runs():
        mine = mine.join(part.where(F.col("run_id") != run_id).select("identity"), "identity", "left_anti")
    return mine


def empty_vault(spark: SparkSession) -> Vault:
    # The optimizer knows that a limit of 0 is empty, so no value moves to look for itself there.
    return Vault(*(spark.createDataFrame([], schema).limit(0) for schema in (MAP_SCHEMA, RUNS_SCHEMA, COUNTERS_SCHEMA)))


@dataclass(frozen=True)
class Assignment:
    """What a run adds to a vault, and the token of every value it met."""

    tokens: DataFrame  # entity_type, value, identity, token, uses -- values are decrypted as they are read, never written
    new_map: DataFrame
    new_runs: DataFrame
    counters: DataFrame
    run_id: str = ""


def distinct_values(occurrences: DataFrame) -> DataFrame:
    """One row per value with its first place and its number of uses.

    Partial aggregation runs before the shuffle, so a value that fills a third
    of all documents arrives as one row per task.  A hash leads the sort of that
    aggregation: types and values begin alike, and rows would be compared byte by byte.
    """
    return occurrences.groupBy(F.xxhash64("entity_type", "value").alias("_hash"), "entity_type", "value").agg(
        F.min(F.struct("doc_ord", "start")).alias("first_seen"), F.count(F.lit(1)).alias("uses")
    ).drop("_hash")


def number_values(values: DataFrame, counters: DataFrame, order: tuple[str, ...] = ("first_seen",)) -> DataFrame:
    """Add ``token_no``: consecutive per entity type in the given order.

    A window per entity type would put all values of one type into one task.
    Range partitions in (type, order) are numbered on their own instead; only
    the block sizes, one row per partition and type, are summed up in a window.
    """
    ranged = values.repartitionByRange("entity_type", *order).sortWithinPartitions("entity_type", *order)
    blocks = staged(
        ranged.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("seq")),
        "numbered", None, "zstd",
    )
    sizes = blocks.groupBy("entity_type", "block").agg(F.count(F.lit(1)).alias("size"), F.min("seq").alias("first"))
    earlier = Window.partitionBy("entity_type").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .join(counters, "entity_type", "left")
        .select(
            "entity_type", "block", (F.col("before") + F.coalesce("last_no", F.lit(0)) - F.col("first") + 1).alias("shift")
        )
    )
    # Bounded by shuffle partitions x entity types, whatever the data.
    return (
        blocks.join(F.broadcast(staged(offsets, "offsets")), ["entity_type", "block"])
        .withColumn("token_no", F.col("seq") + F.col("shift"))
        .drop("block", "seq", "shift")
    )


def assign_tokens(
    occurrences: DataFrame, vault: Vault, key: VaultKey, run_id: str, prefix: str = DEFAULT_PREFIX
) -> Assignment:
    """Give every value a token: a known value keeps its own, a new one gets the
    next number of its entity type, by first place in document order."""
    named = distinct_values(occurrences).withColumn("identity", identity(F.col("entity_type"), F.col("value"), key))
    sealed = encrypt(F.col("value"), F.col("identity"), key)
    with sensitive(named.sparkSession) as spent:
        spent.add("values")
        values = staged(named.select("entity_type", "identity", sealed.alias("value_enc"), "first_seen", "uses"), "values", None, "zstd")
        known = staged(union_of([values.join(part.select("identity", "token"), "identity") for part in vault.maps()]), "known")
        known = known.withColumn("token_no", F.lit(None).cast("long"))
        # A vault that knows none of the values takes nothing off them, so they need not move for it.
        fresh = values if known.isEmpty() else values.join(known, "identity", "left_anti")
        # All values are in ``known`` or ``numbered`` from here on.
        numbered = number_values(fresh, vault.counters)
    numbered = numbered.withColumn("token", F.expr(token_sql("entity_type", "token_no", prefix)))
    shared = ["entity_type", "identity", "value_enc", "token", "token_no", "uses"]
    new = numbered.select(*shared)
    every = known.select(*shared).unionByName(new)
    opened = decrypt(F.col("value_enc"), F.col("identity"), key)
    given = every.select("entity_type", opened.alias("value"), "identity", "token", "uses")
    new_map = new.select("identity", "entity_type", "token_no", "token", "value_enc")
    met = every.select("identity")
    for part in vault.runs():
        met = met.join(part.where(F.col("run_id") == run_id).select("identity"), "identity", "left_anti")
    new_runs = met.withColumn("run_id", F.lit(run_id))
    last = new.groupBy("entity_type").agg(F.max("token_no").alias("last_no"))
    counters = vault.counters.unionByName(last).groupBy("entity_type").agg(F.max("last_no").alias("last_no"))
    return Assignment(given, new_map, new_runs, counters, run_id)


def with_assignment(vault: Vault, assignment: Assignment) -> Vault:
    """The vault after an assignment, as tables (nothing is written)."""
    return replace(
        vault,
        token_map=vault.token_map.unionByName(assignment.new_map),
        token_runs=vault.token_runs.unionByName(assignment.new_runs),
        counters=assignment.counters,
        map_parts=(*vault.maps(), assignment.new_map),
        run_parts=(*vault.runs(), assignment.new_runs),
        made_by=(*vault.makers(), assignment.run_id),
    )


def _opened(entries: DataFrame, uses: DataFrame, counters: DataFrame, key: VaultKey) -> DataFrame:
    """Keys and ``value`` of the entries that ``uses`` asks for, others too where it asks for most of them.

    Ciphertext and identities do not compress and take several times the disk of their values when they move.  Where
    the tokens in use are at least half of all ever given out, entries are opened where they are; where they are fewer, entries
    move to them first, so that no others are opened.  An entry that cannot be opened keeps ``value_enc`` and
    ``identity``, to raise its error where a text needs it.
    """
    given = counters.agg(F.coalesce(F.sum("last_no"), F.lit(0))).first()[0]
    if 2 * uses.count() < given:
        met = uses.select("_hash", "token").join(entries, ["_hash", "token"])
        return _with_values(met, key)
    return _with_values(entries, key)


def _with_values(entries: DataFrame, key: VaultKey) -> DataFrame:
    opened = entries.withColumn("value", decrypt_or_null(F.col("value_enc"), F.col("identity"), key))
    left = [F.when(F.col("value").isNull(), F.col(name)).alias(name) for name in ("value_enc", "identity")]
    return opened.select("_hash", "token", "value", *left)


def restore(
    docs: DataFrame,
    vault: Vault,
    key: VaultKey,
    run_id: str = "",
    prefix: str = DEFAULT_PREFIX,
    text: str = "text",
) -> DataFrame:
    """Put the values back in place of the tokens of a run (all runs if empty).

    Adds ``restored`` and ``unresolved``, the numbers of tokens replaced and
    left, and ``placeholders``, the placeholders of any kind still in the text.
    Texts with tokens are cut once, at their tokens, and staged in pieces (no
    values); the tokens travel to the mapping, not the mapping to the texts, and the pieces are woven with what they
    bring back.  Texts without a token stay in their partition.  So the texts are read twice, once for either kind.
    """
    regex = F.lit(token_pattern(prefix))
    source = text_of(text)
    others = [column_name(name) for name in docs.columns if name != text]
    has_token = F.expr(source).rlike(token_pattern(prefix))

    entries = entries_of(vault, run_id) if run_id else vault.token_map
    cut = docs.where(has_token).withColumn("_regex", regex).selectExpr(
        *others, f"split({source}, _regex, -1) as _gaps", f"regexp_extract_all({source}, _regex, 0) as _tokens",
        "monotonically_increasing_id() as _row",
    )
    cut = staged(cut, "pieces")
    # Tokens begin alike; a hash in front spares their sorts most comparisons.
    by = F.xxhash64("token").alias("_hash")
    found = cut.select("_row", F.posexplode("_tokens").alias("pos", "token")).select("*", by)
    uses = staged(found.groupBy("_hash", "token").agg(F.count(F.lit(1)).alias("uses")), "uses")
    lookup = _opened(entries.select("*", by), uses, vault.counters, key)
    value = F.coalesce("value", decrypt(F.col("value_enc"), F.col("identity"), key))
    looked_up = join_skewed(found, lookup, ["_hash", "token"], "uses", ["_row", "pos"], uses, "left").withColumn("value", value)
    values = looked_up.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", "token").alias("put")))).alias("_puts"),
        F.count("value").alias("restored"),
        (F.count(F.lit(1)) - F.count("value")).alias("unresolved"),
    )
    with_tokens = cut.join(values, "_row").selectExpr(
        *others, f"{woven_sql('_gaps', '_puts.put')} as {column_name(text)}", "restored", "unresolved"
    )
    untouched = docs.where(~has_token).selectExpr(
        *others, f"{source} as {column_name(text)}", "0L as restored", "0L as unresolved"
    )
    opening = F.lit(rf"\[\Q{prefix}\E_")
    return with_tokens.unionByName(untouched).withColumn("placeholders", F.regexp_count(F.expr(column_name(text)), opening))


def purge_run(vault: Vault, run_id: str) -> tuple[Vault, DataFrame]:
    """Forget a run.  Values no other run used are removed; the second result
    counts them.  Counters stay, so no number is given out twice."""
    runs = vault.token_runs.where(F.col("run_id") != run_id)
    kept = vault.token_map.join(runs, "identity", "left_semi")
    removed = vault.token_map.join(runs, "identity", "left_anti").agg(F.count(F.lit(1)).alias("removed"))
    return replace(vault, token_map=kept, token_runs=runs, map_parts=(), run_parts=(), made_by=()), removed


def rekey(vault: Vault, old: VaultKey, new: VaultKey) -> Vault:
    """The same tokens under a new key, identities included, so that a value
    met again later still finds its token."""
    entries = vault.token_map.select(
        F.col("identity").alias("old_identity"),
        "entity_type",
        "token_no",
        "token",
        decrypt(F.col("value_enc"), F.col("identity"), old).alias("value"),
    ).withColumn("identity", identity(F.col("entity_type"), F.col("value"), new))
    token_map = entries.select(
        "identity",
        "entity_type",
        "token_no",
        "token",
        encrypt(F.col("value"), F.col("identity"), new).alias("value_enc"),
    )
    names = entries.select("old_identity", "identity")
    runs = vault.token_runs.withColumnRenamed("identity", "old_identity").join(names, "old_identity")
    return replace(vault, token_map=token_map, token_runs=runs.select("identity", "run_id"), map_parts=(), run_parts=(), made_by=())


def status(vault: Vault) -> DataFrame:
    """Entries per entity type, and the last number given out."""
    entries = vault.token_map.groupBy("entity_type").agg(F.count(F.lit(1)).alias("entries"))
    return vault.counters.join(entries, "entity_type", "full").select(
        "entity_type", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("last_no", F.lit(0)).alias("last_no")
    )
