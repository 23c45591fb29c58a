"""Connected components of a large graph by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.skew import join_skewed
from veilframe.session import staged


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every end of ``edges`` (``a``, ``b`` long): the smallest node it is connected to.

    Each round every node takes the smallest label among its neighbours, tells
    it to its own root, and takes the label of its label.  Trees hook onto
    trees and paths halve, so rounds grow with the logarithm of a component's
    diameter.  Labels of a round are written to the shared folder, which also
    cuts the lineage.  Joins on neighbours meet at most a node's own links;
    joins on labels, where a large component is one key, are split by
    ``join_skewed``.  Loops and repeated edges do no harm; without edges the
    result is empty.
    """
    both = staged(edges.union(edges.select("b", "a")).where("a is not null and b is not null").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "root")
        met = labels.withColumnRenamed("root", "before").join(
            told.groupBy("node").agg(F.min("root").alias("told")), "node"
        )
        met = staged(met.select("node", "before", F.least("before", "told").alias("told")), "met")
        hooks = met.groupBy(F.col("before").alias("node")).agg(F.min("told").alias("hook"))
        least = staged(met.join(hooks, "node", "left").select("node", "before", F.least("told", "hook").alias("hop")), "hops")
        uses = least.groupBy("hop").agg(F.count(F.lit(1)).alias("uses"))
        jumps = least.select(F.col("node").alias("hop"), F.col("hop").alias("root")).join(uses, "hop")
        labels = staged(
            join_skewed(least, jumps, ["hop"], "uses", ["node"]).select("node", "root", F.col("before")), "labels"
        )
        if labels.where("root <> before").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
