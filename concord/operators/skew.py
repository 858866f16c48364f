"""Joins and running values that survive one key holding a large share of the rows."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than one row in HOT_SHARE. Fewer than HOT_SHARE keys can,
# whatever the size of the table, so the hot-key table is always small enough to broadcast.
HOT_SHARE = 1000


def hot_keys(fact: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys holding more than 1/HOT_SHARE of all rows: at most HOT_SHARE - 1 rows."""
    counts = fact.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.where(F.col("_n") * HOT_SHARE > total.scalar()).select(*on)


def spread_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``fact`` to ``dim`` where one key may hold a large share of the rows of ``fact``.

    Adaptive execution splits the partitions of such keys as it meets them, equal rows and rows without a key included, and
    broadcasts a side that turns out small: no input is evaluated twice to find that out beforehand. Where the result is
    grouped by the same key, ``spark.sql.adaptive.forceOptimizeSkewedJoin`` lets it split there too.
    ``how`` is one of inner, left, left_semi, left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join cannot do a {how} join")
    return fact.join(dim, list(on), how)


def blocked_running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    block: Column,
    running: Mapping[str, tuple[str, Column, bool]],
) -> DataFrame:
    """Running sums, maxima and minima within ``group``, without one task per group.

    ``block`` cuts a group along its order: rows of a lower block all precede rows of a higher
    one. Totals per (group, block) come from a partial aggregation, their running value is a
    window over that small table, and the rows themselves are only windowed inside a block.
    ``running`` maps a new column to (fn, value, inclusive) with fn ``sum``, ``max`` or ``min``.
    An exclusive value is null (sum: 0) where nothing precedes the row.
    """
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    group = list(group)
    cut = df.withColumn("_block", block)
    totals = cut.groupBy(*group, "_block").agg(
        *[fns[fn](value).alias(f"_t_{name}") for name, (fn, value, _) in running.items()]
    )
    over_blocks = (
        Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = totals.select(
        *group,
        "_block",
        *[fns[fn](f"_t_{name}").over(over_blocks).alias(f"_b_{name}") for name, (fn, _, _) in running.items()],
    )
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    rows = cut
    for name, (fn, value, inclusive) in running.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        rows = rows.withColumn(f"_l_{name}", fns[fn](value).over(frame))
    same = [rows[g].eqNullSafe(before[g]) for g in group] + [rows["_block"].eqNullSafe(before["_block"])]
    joined = rows.join(before, same, "left").drop(*[before[g] for g in group], before["_block"])
    for name, (fn, _, _) in running.items():
        local, prior = F.col(f"_l_{name}"), F.col(f"_b_{name}")
        if fn == "sum":
            value = F.coalesce(local, F.lit(0)) + F.coalesce(prior, F.lit(0))
        else:
            value = (F.greatest if fn == "max" else F.least)(local, prior)
        joined = joined.withColumn(name, value)
    return joined.select(*df.columns, *running)


#: Bounds of a large group: it is cut into one block more, of about as many rows each.
BOUNDS = 127


def data_blocks(df: DataFrame, group: Sequence[str], order: str, rows: int, out: str = "_block") -> DataFrame:
    """Adds ``out``: the block of a row within its group, numbered along ``order``.

    A group of at most ``rows`` rows is one block. A larger one is cut at approximate quantiles of its own order values, so that
    neither sparse nor dense values nor one very large group make a large block; rows of one order value stay together. Counts
    and quantiles come from partial aggregations, and there are fewer large groups than there are ``rows`` in the table.
    """
    keys = [f"_k{i}" for i in range(len(group))] or ["_all"]
    keyed = df.select(*([F.col(g).alias(k) for g, k in zip(group, keys)] or [F.lit(0).alias("_all")]), F.col(order).alias("_o"))
    large = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).drop("_n")
    same = lambda x, y: functools.reduce(Column.__and__, [x(k).eqNullSafe(F.col(f"{y}.{k}")) for k in keys])
    inside = keyed.alias("x").join(large.alias("y"), same(lambda k: F.col(f"x.{k}"), "y"), "left_semi")
    cuts = [(i + 1) / (BOUNDS + 1) for i in range(BOUNDS)]
    bounds = inside.groupBy(*keys).agg(F.percentile_approx("_o", cuts).alias("_bounds"))
    of = dict(zip(keys, group))
    joined = df.alias("x").join(bounds.alias("y"), same(lambda k: F.col(f"x.{of[k]}") if k in of else F.lit(0), "y"), "left")
    number = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col(f"x.{order}"))), F.lit(0))
    return joined.select("x.*", F.when(F.col("_bounds").isNull(), 0).otherwise(number).alias(out))


def blocked_number(df: DataFrame, group: Sequence[str], order: str, out: str, rows: int = 1_000_000) -> DataFrame:
    """1-based position within ``group`` by ``order``, in blocks of the data's own (``data_blocks``)."""
    cut = data_blocks(df, group, order, rows, "_cut")
    return blocked_running(cut, group, [F.col(order)], F.col("_cut"), {out: ("sum", F.lit(1), True)}).drop("_cut").withColumn(
        out, F.col(out).cast("long")
    )


def first_members(df: DataFrame, group: Sequence[str], member: str, n: int, out: str) -> DataFrame:
    """The first ``n`` distinct members of each group, sorted, as an array of at most ``n``.

    The rank filter is applied before the shuffle (window group limit), so a hot group sends at
    most ``n`` rows per task.
    """
    distinct = df.select(*group, member).distinct()
    ranked = distinct.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(member)))
    return (
        ranked.where(F.col("_rn") <= n)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(member)).alias(out))
    )


# Fixed bounds: a side of at most this many rows and bytes (as JSON text) may be broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 2**20


def lookup_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a table that is usually small: broadcast when it is, ``spread_join`` when it is not.

    The size is checked on at most ``BROADCAST_ROWS + 1`` rows of ``dim``, before the join.
    """
    rows, size = dim.limit(BROADCAST_ROWS + 1).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dim.columns])))), F.lit(0))
    ).first()
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return fact.join(F.broadcast(dim), list(on), how)
    return spread_join(fact, dim, on, how)
