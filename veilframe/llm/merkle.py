"""A Merkle manifest of a data set, with a proof for every row by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.skew import join_skewed
from veilframe.session import staged

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the roots of all groups; groups are numbered from 0.
TOP = -1
NODE = ["tree", "level", "place"]
UP = ["up_tree", "up_level", "up_place"]


def hashed(text: Column) -> Column:
    """SHA-256 in lowercase hex."""
    return F.sha2(text, 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: of each field ``-`` if null, else its length in UTF-8, a colon and its value as text."""
    texts = [one.cast("string") for one in fields]
    shown = [F.coalesce(F.concat(F.octet_length(one).cast("string"), F.lit(":"), one), F.lit("-")) for one in texts]
    return hashed(F.concat(*shown))


# --- numbers without a task that holds a whole group -------------------------


def _ranged(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ordered.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("seq")), label)


def _ranked(groups: DataFrame) -> DataFrame:
    """Groups (distinct ``_group``) with their number in order as ``tree``."""
    blocks = _ranged(groups, ["_group"], "groups")
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per partition.
    shifts = sizes.select("block", (before - F.col("first")).alias("shift"))
    return blocks.join(F.broadcast(shifts), "block").withColumn("tree", F.col("seq") + F.col("shift")).drop("block", "seq", "shift")


def _placed(told: DataFrame, order: list[str]) -> DataFrame:
    """``told`` (``_group`` and others) with ``tree``, the group's number in order, ``place``, the row's in its group, and
    ``size``, the group's rows.

    Range partitions are numbered each on its own, with an offset for each partition and group.
    """
    blocks = _ranged(told, ["_group", *order], "places")
    sizes = staged(blocks.groupBy("_group", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")), "blocks")
    groups = _ranked(sizes.groupBy("_group").agg(F.sum("n").alias("size"))).select(F.col("_group").alias("_named"), "size", "tree")
    earlier = Window.partitionBy("_group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    shifts = shifts.join(groups, F.col("_group").eqNullSafe(F.col("_named")))
    shifts = shifts.select(F.col("_group").alias("_named"), F.col("block").alias("_block"), "shift", "size", "tree")
    # A key of this join is what one partition holds of a group.
    joined = blocks.join(shifts, (F.col("block") == F.col("_block")) & F.col("_group").eqNullSafe(F.col("_named")))
    return joined.withColumn("place", F.col("seq") + F.col("shift")).drop("_group", "block", "seq", "_named", "_block", "shift")


# --- the tree ----------------------------------------------------------------


def _runs(nodes: DataFrame, label: str, *more: str) -> DataFrame:
    """Runs of one level's nodes (``tree``, ``place``, ``digest``, ``size``) with their hash, which is the node above."""
    run = nodes.groupBy("tree", F.floor(F.col("place") / FANOUT).cast("long").alias("up"), "size").agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", *more))).alias("run")
    )
    above = hashed(F.array_join(F.transform("run", lambda node: _hex(node["digest"])), ""))
    return staged(run.withColumn("above", F.unhex(above)), label)


def _above(runs: DataFrame) -> DataFrame:
    size = F.ceil(F.col("size") / FANOUT).cast("long")
    return runs.select("tree", F.col("up").alias("place"), F.col("above").alias("digest"), size.alias("size"))


def _pointers(runs: DataFrame, level: int, *more: str) -> DataFrame:
    """Each node of the runs: its key, its one step, and the node above as pointer; the root itself is not pointed to."""
    one = runs.select("tree", "up", "size", F.col("run.digest").alias("all"), F.posexplode("run").alias("at", "node"))
    joined = lambda part: F.aggregate(part, F.lit(b""), lambda a, b: F.concat(a, b))
    step = F.struct(
        joined(F.slice("all", F.lit(1), F.col("at"))).alias("before"),
        joined(F.slice("all", F.col("at") + 2, F.lit(FANOUT))).alias("after"),
    )
    last, top = F.col("size") <= FANOUT, F.col("tree") == TOP
    # The root of a group is a leaf of the tree over all groups.
    return one.select(
        "tree", F.lit(level).alias("level"), "node.place", F.array(step).alias("steps"), F.lit(None).cast("binary").alias("subroot"),
        F.when(last & ~top, F.lit(TOP)).when(~last, F.col("tree")).cast("long").alias("up_tree"),
        F.when(last, F.lit(0)).otherwise(F.lit(level + 1)).alias("up_level"),
        F.when(last, F.col("tree")).otherwise(F.col("up")).alias("up_place"),
        *(f"node.{name}" for name in more),
    )


def _no_steps() -> Column:
    return F.expr("cast(array() as array<struct<before: binary, after: binary>>)")


def _jumped(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows after taking over the steps and the pointer of the node that they point to."""
    pending = rows.where("up_tree is not null")
    uses = staged(pending.groupBy(*UP).agg(F.count(F.lit(1)).alias("uses")), "pointers")
    above = nodes.select(
        *(F.col(name).alias(up) for name, up in zip(NODE, UP, strict=True)),
        F.col("steps").alias("more"), F.col("subroot").alias("met"), *(F.col(up).alias(f"to_{up}") for up in UP),
    )
    met = join_skewed(pending, uses.join(above, UP), UP, "uses", ["tree", "place"], uses)
    met = met.withColumn("steps", F.concat("steps", "more")).withColumn("subroot", F.coalesce("subroot", "met"))
    met = met.withColumns({up: F.col(f"to_{up}") for up in UP})
    return met.select(*rows.columns).unionByName(rows.where("up_tree is null"))


def _height(size: int) -> int:
    height = 0
    while size > 1:
        size, height = -(-size // FANOUT), height + 1
    return height


def proofs(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group_col: str = "lang",
    order_col: str = "doc_id",
    claimed: dict[str, Column] | None = None,
) -> DataFrame:
    """The manifest of ``docs``: ``doc_id``, ``leaf``, ``claim``, ``subroot``, ``root`` (hex), ``steps`` of every row.

    Rows with one value of ``group_col`` are leaves in ascending order of ``order_col``; every
    eight consecutive nodes become the hash of their digests, until one is left, the group's subroot.
    Subroots in the order of their groups become the root likewise.  ``steps`` lead from the leaf to the root: an array of
    (``before``, ``after``), the digests of 32 bytes that stand before and behind the node in its run; both are empty in a run of one.
    ``claim`` is the leaf that somebody else would compute who has ``claimed`` values of some fields.

    A null field shows as ``-``, a null group is one of its own and comes first, a null id comes first in its group.
    Rows with the same id are ordered by their hash, so it makes no difference how equal rows change places.
    No rows give no rows.  Other columns are ignored.

    Each node points to the one above and holds one step.  In each round a node appends the steps of the
    node it points to and takes over its pointer: distances double until every leaf has reached the root.  A group may hold
    any share of the rows; nodes near the root, which many others point to, are split by ``join_skewed``.
    """
    own = leaf([F.col(name) for name in fields])
    theirs = own
    if claimed:
        same = F.lit(True)
        for name, value in claimed.items():
            same &= value.eqNullSafe(F.col(name))
        theirs = F.when(same, own).otherwise(leaf([claimed.get(name, F.col(name)) for name in fields]))
    told = docs.select(F.col(group_col).alias("_group"), F.col(order_col).alias("doc_id"), own.alias("leaf"), theirs.alias("claim"))
    told = staged(told.select("_group", "doc_id", F.unhex("leaf").alias("digest"), F.unhex("claim").alias("claim")), "leaves")
    # Equal rows are told apart by where they stand, so that a range need not hold all of them.
    told = told.withColumn("row_no", F.monotonically_increasing_id())
    leaves = _placed(told, ["doc_id", "digest", "claim", "row_no"]).drop("row_no")

    nodes = staged(leaves, "placed")
    shape = nodes.where("place = 0").agg(F.count(F.lit(1)).alias("trees"), F.max("size").alias("most")).first()
    if not shape.trees:
        empty = F.lit(None).cast("string")
        return nodes.select("doc_id", _hex("digest").alias("leaf"), _hex("claim").alias("claim"), empty.alias("subroot"), empty.alias("root"), _no_steps().alias("steps"))
    payload, inner = ("digest", "doc_id", "claim"), []
    # A group's only row is its root.
    point = [F.lit(value).cast(kind).alias(up) for value, kind, up in ((TOP, "long", UP[0]), (0, "int", UP[1]))]
    alone = nodes.where("size = 1").select(
        "tree", F.lit(0).alias("level"), "place", _no_steps().alias("steps"), F.lit(None).cast("binary").alias("subroot"),
        *point, F.col("tree").alias(UP[2]), *payload,
    )
    runs = _runs(nodes.where("size > 1"), "runs", "doc_id", "claim")
    leaves = _pointers(runs, 0, *payload).unionByName(alone)
    roots, level = [nodes.where("size = 1").select("tree", "digest")], 0
    while level < _height(shape.most):
        level += 1
        nodes = _above(runs)
        roots.append(nodes.where("size = 1").select("tree", "digest"))
        if level < _height(shape.most):
            runs = _runs(nodes.where("size > 1"), "runs")
            inner.append(_pointers(runs, level))
    top = roots[0]
    for found in roots[1:]:
        top = top.unionByName(found)
    top = staged(top.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(shape.trees).alias("size")), "subroots")
    nodes = top
    for level in range(_height(shape.trees)):
        runs = _runs(nodes, "runs")
        found = _pointers(runs, level)
        if level == 0:
            found = found.drop("subroot").join(top.select("place", F.col("digest").alias("subroot")), "place")
        # What points to the root has arrived.
        inner.append(found)
        nodes = _above(runs)
    root = nodes.select("digest").first().digest
    if shape.trees == 1:
        inner.append(
            top.select("tree", F.lit(0).alias("level"), "place", _no_steps().alias("steps"), F.col("digest").alias("subroot"),
                       *(F.lit(None).cast(kind).alias(up) for up, kind in zip(UP, ("long", "int", "long"), strict=True)))
        )
    above = inner[0]
    for part in inner[1:]:
        above = above.unionByName(part)
    above = staged(above, "nodes")

    hops = max(_height(shape.most), 1) + max(_height(shape.trees), 1)
    rounds = (hops - 1).bit_length()
    for number in range(rounds):
        leaves = _jumped(leaves, above)
        if number + 1 < rounds:
            leaves, above = staged(leaves, "leaves"), staged(_jumped(above, above), "nodes")
    return leaves.select(
        "doc_id", _hex("digest").alias("leaf"), _hex("claim").alias("claim"), _hex("subroot").alias("subroot"),
        F.lit(root.hex()).alias("root"), "steps",
    )


def siblings(steps: Column) -> Column:
    """The digests of a proof as hex, from left to right and from the leaf's level up."""
    return F.array_join(F.transform(steps, lambda step: F.concat(_hex(step["before"]), _hex(step["after"]))), "")


def folded(digest: Column, steps: Column) -> Column:
    """The root that follows from a leaf (hex) and a proof."""
    return F.aggregate(steps, digest, lambda one, step: hashed(F.concat(_hex(step["before"]), one, _hex(step["after"]))))
