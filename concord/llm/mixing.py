"""Mixing sources to target weights: hash-threshold histograms, no sort of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import WORD, durable, written

HASH_BITS, LEVEL_BITS = 48, 12
#: Beyond so many sources their table is joined, not broadcast (a row of it is under 200 bytes).
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column, text: Column, seed: str = "") -> Column:
    """A document's place in [0, 2**48) by its id and text: its share of the key space, the same in every run."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), content).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` numbered from 0 by code point, null last. Range partitions are numbered within, then shifted by what precedes them."""
    parts = durable(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("within", within).join(starts, "part").select(*sources.columns, (F.col("start") + F.col("within") - 1).alias("number"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, int]:
    """(source, source_size, target) and the number of sources.

    All sizes are shared by weight; a source above ``cap`` times its size stops there and its excess is shared again.
    That fixed point is target = min(cap * size, level * weight) for one level. It is found by raising the level until no
    more source stops: one aggregation over the table of sources a step, of which only the sums reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    table = written(ranked(totals).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most")))
    level, stopped = None, -1
    while True:
        stops = F.lit(False) if level is None else F.col("most") <= F.lit(level) * F.col("weight")
        n, total, held, rest, count = table.agg(
            F.count("*"), F.sum("source_size"), F.sum(F.when(stops, F.col("most")).otherwise(0)),
            F.sum(F.when(stops, 0).otherwise(F.col("weight"))), F.sum(F.when(stops, 1).otherwise(0)),
        ).first()
        if not n or count == stopped or not rest:
            break
        level, stopped = (total - held) / rest, count
    target = F.least(F.col("most").cast("double"), F.lit(float(level or 0.0)) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target")), n


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", seed: str = "", keep: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words of each document that the mix takes.

    With ``keep``, all columns of ``docs`` and the last four; columns of their names are replaced.

    A document's size is its number of words. A source is taken whole as often as its target holds it; of the rest, the
    documents whose place (a hash of id and text) is under the source's threshold are taken once more. The threshold comes
    from histograms: words summed by source and the first 12 bits of the place, then only the bucket in which the budget
    ends is summed by the next 12 bits, and so on to all 48. The documents at the threshold itself, as a rule repeated rows,
    share what is left in proportion to their size, as a last, partial copy: the fractions are carried from one to the next, so
    a source takes its target to the word. Thresholds are nested: a larger target keeps every document that a smaller one took.
    They are numbered within their input partition, and partitions meet by their sums, so a row repeated without end is never
    one task. ``docs`` should be a table of files, which reads as the same partitions each time.

    Sizes are written once (id, source, size, place) and read by each level. Every shuffle carries sums by source and
    bucket, summed before they move, so a source with most of the rows costs no task more. Windows run over at most 4,096
    buckets of a source.

    Null and empty texts have size 0 and take 0; null is a source of its own, last in order. A source without words has
    target 0. Repeated rows and ids count each time; which of several equal rows takes the last words is left open. Columns other than the three named are not read. Empty tables give an empty table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sizes = written(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text"), seed).alias("place"), F.spark_partition_id().alias("part")))
    sources, n = source_targets(sizes, weights, cap)
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_SOURCES else (lambda df: df)

    budget, size = F.floor(F.col("target") + 0.5), F.col("source_size")
    whole = F.when(size > 0, F.floor(budget / size)).otherwise(0)
    ends = sources.withColumn("whole", whole.cast("long")).withColumn("rest", (budget - F.col("whole") * size).cast("long"))
    ends = ends.withColumn("prefix", F.lit(0).cast("long")).withColumn("total", size)
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        here = F.shiftright(F.col("d.place"), bits + LEVEL_BITS) == F.col("e.prefix")
        inside = sizes.alias("d").join(small(ends).alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & here)
        names = ["source", "source_size", "target", "whole", "rest"]
        buckets = inside.groupBy(*[F.col(f"e.{c}").alias(c) for c in names], F.shiftright(F.col("d.place"), bits).alias("prefix")).agg(F.sum("d.size").alias("total"))
        until = F.sum("total").over(Window.partitionBy("source").orderBy("prefix"))
        start = F.col("until") - F.col("total")
        ends = buckets.withColumn("until", until).where((start <= F.col("rest")) & (F.col("rest") < F.col("until")))
        ends = ends.select("source", "source_size", "target", "whole", (F.col("rest") - start).alias("rest"), "prefix", "total")

    ends = ends.select(F.col("source").alias("end_source"), F.col("prefix"), F.col("rest"), F.col("total"), F.col("whole"))
    limits = sources.join(small(ends), F.col("source").eqNullSafe(F.col("end_source")), "left").drop("end_source")
    extra = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")] if keep else []
    if keep:
        whole_rows = docs.select(*extra, F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"), place(F.col(id_col), F.col(text_col), seed).alias("__place"), F.spark_partition_id().alias("__part"))
    else:
        whole_rows = sizes.select("doc_id", F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("place").alias("__place"), F.col("part").alias("__part"))
    limits = limits.select(F.col("source").alias("__from"), "source_size", "target", *[F.col(c).alias(f"__{c}") for c in ("prefix", "rest", "total", "whole")])
    found = whole_rows.join(small(limits), F.col("__source").eqNullSafe(F.col("__from")))
    # Words at each threshold in earlier partitions, then in earlier rows of the partition.
    ties = sizes.alias("d").join(small(ends).alias("e"), F.col("d.source").eqNullSafe(F.col("e.end_source")) & (F.col("d.place") == F.col("e.prefix")))
    parts = ties.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    earlier = F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("__at"), F.col("part").alias("__of"), F.coalesce(earlier, F.lit(0)).alias("__earlier"))
    tied, size = F.col("__place") == F.col("__prefix"), F.col("__size")
    rows = found.where(tied).join(parts, F.col("__source").eqNullSafe(F.col("__at")) & (F.col("__part") == F.col("__of")))
    upto = Window.partitionBy("__source", "__part").orderBy("__size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__until", F.col("__earlier") + F.sum("__size").over(upto))
    share = lambda words: f"(CAST({words} AS DECIMAL(20, 0)) * __rest) DIV __total"
    rows = rows.withColumn("__once", F.expr(f"{share('__until')} - {share('__until - __size')}")).select(*found.columns, "__once")
    rest = found.where(F.coalesce(~tied, F.lit(True))).withColumn("__once", F.when(F.col("__place") < F.col("__prefix"), size).otherwise(0).cast("long"))
    found, once = rest.unionByName(rows), F.col("__once")
    taken = F.coalesce(F.col("__whole") * size + once, F.lit(0)).cast("long")
    first = [F.col(c) for c in extra] if keep else [F.col("doc_id"), F.col("__source").alias("source")]
    return found.select(*first, size.alias("size"), "source_size", "target", taken.alias("taken"))
