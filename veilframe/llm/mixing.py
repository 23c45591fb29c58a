"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.batches import texts_of
from veilframe.session import staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: Nothing is taken more often than this.
REPEATS = 2
#: A document is queued in packets of at most this part of its source's target.
PACKETS = 1000
#: Parts of a source whose sizes are summed apart, and ranges of virtual time.
PARTS = 1 << 12
RANGES = 1 << 12
SEED = "mix:"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place_in_queue(doc_id: Column) -> Column:
    """A fixed shuffle: 60 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """``source``, ``source_no``, ``source_size``, ``target``, ``budget`` from ``source`` and ``size`` of all rows.

    Sources by code point, null last, have ``weights`` in turn and share
    ``share`` times all sizes.  A target stops at ``repeats`` times its source's
    size and the rest is shared again by weight: the level to which all sources
    rise is found by one pass over the sources in the order in which they fill
    up.  Sources are few enough for one task: one row each.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", repeats * F.col("source_size"))
    full_at = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    filled = F.coalesce(F.sum("most").over(full_at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(full_at.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    levels = sources.withColumn("budget", budget).withColumn("level", (F.col("budget") - filled) / rest)
    open_level = F.when(F.col("level") < F.col("most") / F.col("weight"), F.col("level"))
    levels = levels.withColumn("level", F.max(open_level).over(Window.partitionBy()))
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return levels.select("source", "source_no", "source_size", target.alias("target"), F.floor("budget").alias("budget"))


def _placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with their source's figures and ``packets``.

    ``parts`` has each part of each source with the sizes before it, so running
    totals need the rows of one part only: a source of any size is spread.
    """
    keys = [F.col("named"), F.col("name"), F.col("part")]
    within = Window.partitionBy(*keys).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(parts, ["named", "name", "part"]).withColumn("done", F.col("before") + F.sum("size").over(within))
    quantum = F.greatest(F.lit(1), F.floor(F.col("target") / PACKETS))

    def packets(copy: int) -> Column:
        # Only packets that start before their source's target is served can be reached.
        start = F.col("done") - F.col("size") + copy * F.col("source_size")
        served = F.least(F.col("size").cast("double"), F.col("target") - start)
        number = F.ceil(served / quantum)

        def packet(at: Column) -> Column:
            first = start + at * quantum
            words = F.least(quantum, start + F.col("size") - first)
            finish = (first + words) / F.col("target")
            return F.struct(finish.alias("finish"), "source_no", first.alias("first"), words.alias("words"))

        numbers = F.sequence(F.lit(0).cast("long"), F.greatest(number, F.lit(1)) - 1)
        return F.when((F.col("size") > 0) & (served > 0), F.transform(numbers, packet))

    return placed.withColumn("copies", F.array(*(packets(copy) for copy in range(REPEATS))))


def _queue(rows: DataFrame) -> DataFrame:
    """Columns that decide a row's place, from ``doc_id``, ``source`` and ``size``."""
    key = place_in_queue(F.col("doc_id"))
    return rows.withColumns(
        {
            "key": key,
            "part": F.shiftright(key, 60 - (PARTS.bit_length() - 1)),
            "named": F.col("source").isNotNull(),
            "name": F.coalesce("source", F.lit("")),
        }
    ).drop("source")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole_rows: bool = False
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` of every row of ``docs``, and ``copies_taken``, the
    words taken of its first and second copy.

    A size is the number of words between space and 9-13; null and blank texts
    have 0 and are never taken.  Each source's documents stand in a queue in
    shuffled order, its second copies after all first ones.  A packet's virtual
    finish time is the words of its source up to its end over the source's
    target; all packets are ordered by it (ties: source, place) and served until
    the budget is reached, where the last is cut.  Documents are queued in
    packets of at most a thousandth of the target, so that a very long one
    can't hold its source off its target.  The order depends on ids and sizes
    alone: reruns agree, and rows that share both are interchangeable.  A null
    source is a source, a null id is an id.  Without words nothing is taken.

    Running totals are made from sums of parts of each source and of ranges of
    virtual time; only the range in which the budget ends is sorted.  With
    ``whole_rows`` the result has all columns of ``docs`` as ``row`` too.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col, F.col(source_col).alias("source"))
    sized = staged(texts.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    goals = targets(sized)
    queued = _queue(sized)
    by_part = Window.partitionBy("named", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = queued.groupBy("named", "name", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(by_part), F.lit(0))).drop("part_size")
    goals = goals.withColumns({"named": F.col("source").isNotNull(), "name": F.coalesce("source", F.lit(""))})
    parts = staged(parts.join(goals.drop("source"), ["named", "name"]), "parts")
    placed = staged(_placed(queued, parts).drop("key"), "placed")

    packets = placed.select("budget", F.explode(F.flatten(F.filter("copies", lambda c: c.isNotNull()))).alias("packet"))
    packets = packets.select("budget", "packet", F.least(F.floor(F.col("packet.finish") * RANGES), F.lit(2 * RANGES)).alias("span"))
    spans = packets.groupBy("span", "budget").agg(F.sum("packet.words").alias("words"))
    upto = F.sum("words").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0))
    spans = spans.withColumn("upto", upto).withColumn("ahead", F.col("upto") - F.col("words"))
    last = staged(spans.where("ahead < budget and upto >= budget").select("span", "ahead"), "span")
    ordered = packets.join(F.broadcast(last), "span")
    total = F.sum("packet.words").over(Window.partitionBy("span").orderBy("packet").rowsBetween(Window.unboundedPreceding, 0))
    ordered = ordered.withColumn("total", F.col("ahead") + total)
    reached = ordered.where("total >= budget and total - packet.words < budget")
    cut = staged(
        reached.select(F.col("packet").alias("cut"), (F.col("budget") - F.col("total") + F.col("packet.words")).alias("rest")),
        "cut",
    )

    if whole_rows:
        full = docs.select(
            F.struct("*").alias("row"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        )
        placed = _placed(_queue(full), parts)

    def served(packets: Column) -> Column:
        def words(packet: Column) -> Column:
            return F.when(packet < F.col("cut"), packet["words"]).when(packet == F.col("cut"), F.col("rest")).otherwise(0)

        return F.coalesce(F.aggregate(packets, F.lit(0).cast("long"), lambda acc, p: acc + words(p)), F.lit(0))

    # The cut is one row, or none when there are no words.
    out = placed.withColumn("one", F.lit(1)).join(F.broadcast(cut.withColumn("one", F.lit(1))), "one", "left")
    out = out.withColumn("copies_taken", F.transform("copies", served))
    taken = F.aggregate("copies_taken", F.lit(0).cast("long"), lambda acc, words: acc + words)
    kept = ["row"] if whole_rows else []
    return out.select(*kept, "doc_id", "size", "source_size", "target", taken.alias("taken"), "copies_taken")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that the mix takes, with all columns of ``docs``: a row for each copy, its text cut where its copy was."""
    copies = mixed(docs, id_col, text_col, source_col, whole_rows=True).select(
        "row", "size", F.explode("copies_taken").alias("words")
    )
    pieces = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col(f"row.{text_col}"))
    row = F.col("row").withField(text_col, text)
    return copies.where("words > 0").select(row.alias("row")).select("row.*")
