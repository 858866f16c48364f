"""Connected components of links between ids, by hooking to smaller ids and pointer jumping."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import durable


#: Rows of a partition of the loop's tables, which hold ids only. Small tables are no work for hundreds of tasks.
PART_ROWS = 250_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows in as many partitions as they fill, no fewer than there are cores."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / PART_ROWS)))


def roots(parents: DataFrame, rows: int) -> DataFrame:
    """(node, root) of a forest of at most ``rows`` (node, parent), without cycles: each round doubles the length of the jumps."""
    jumps = durable(few(parents.select("node", F.col("parent").alias("root")), rows))
    while True:
        up = jumps.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        further = jumps.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
        next_jumps = durable(few(further, rows))
        if next_jumps.where("moved").isEmpty():
            return next_jumps.select("node", "root")
        jumps = next_jumps.select("node", "root")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of every node with a link in ``links`` (a, b): the least node it can reach.

    ``known`` is the result for earlier links, which count with these; only links between its components cost rounds.

    A round hooks every node to its least smaller neighbour (an aggregation, summed before it moves), finds the roots of
    that forest by pointer jumping, and carries the links over to the roots; links inside a component vanish. Every
    round's tables are checkpointed, none reaches the driver.
    """

    def carried(links: DataFrame, to: DataFrame) -> DataFrame:
        """The distinct links between the roots of their ends, greater first."""
        to = to.select(F.col("node").alias("from"), F.col("root").alias("to"))
        one = links.join(to, F.col("a") == F.col("from"), "left").select(F.coalesce("to", "a").alias("a"), "b")
        return ordered(one.join(to, F.col("b") == F.col("from"), "left").select("a", F.coalesce("to", "b").alias("b")))

    def ordered(links: DataFrame) -> DataFrame:
        return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    labels = known
    left = durable(ordered(links) if known is None else carried(links, known))
    rows = left.count()
    if not rows:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if known is None else known
    size = 2 * rows + (0 if known is None else known.count())
    while rows:
        left = few(left, rows)
        forest = roots(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), rows)
        if labels is None:
            labels = forest
        else:
            to = forest.select(F.col("node").alias("from"), F.col("root").alias("to"))
            old = labels.join(to, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
            new = forest.join(labels.select("node"), "node", "left_anti")
            labels = durable(few(old.unionByName(new), size))
        left = durable(few(carried(left, forest), rows))
        rows = left.count()
    return durable(few(labels.unionByName(labels.select(F.col("root").alias("node"), "root")).distinct(), size))
