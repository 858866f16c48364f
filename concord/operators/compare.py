"""Typed comparison. Left is under test, right is the expectation, and the two never swap."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.numbers import is_finite, num_equal
from concord.operators.nodes import AFTER_ALL, VALUE, topmost
from concord.operators.skew import data_blocks

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _cell_type(df: DataFrame, column: str) -> str:
    kind = dict(df.dtypes)[column]
    if kind in NUMERIC or kind.startswith("decimal"):
        return "number"
    return "boolean" if kind == "boolean" else "string"


def _one_per_key(df: DataFrame, keys: Sequence[str], cols: Sequence[str], side: str) -> DataFrame:
    """Records by key. A key met twice fails the run: such tables are bags (``multiset_diff``)."""
    record = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"_n_{side}"), F.min(record).alias(f"_{side}")
    ).withColumn(
        f"_{side}",
        F.when(
            F.col(f"_n_{side}") > 1,
            F.raise_error(F.concat_ws(" ", F.lit(f"{side} key met twice:"), *[F.col(k).cast("string") for k in keys])),
        ).otherwise(F.col(f"_{side}")),
    ).drop(f"_n_{side}")


def diff(
    left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str], unique: bool = False
) -> DataFrame:
    """Differences of two keyed tables, one row each: keys, field, kind, left, right.

    Kinds: ``missing`` (the left lacks the record; field is null), ``extra`` (the right lacks it),
    ``type`` (null against a value, or values of unlike JSON type) and ``value``. Numbers compare
    under the relative tolerance, everything else exactly. ``unique=True`` states that keys are
    unique and saves the check.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        if unique:
            return df.select(*keys, F.struct(*[F.col(c) for c in cols]).alias(f"_{name}"))
        return _one_per_key(df, keys, cols, name)

    both = side(left, "left").join(side(right, "right"), list(keys), "full_outer")
    l_types = {c: _cell_type(left, c) for c in cols}
    r_types = {c: _cell_type(right, c) for c in cols}

    def found(field: str | None, kind: str | Column, l: Column, r: Column) -> Column:
        return F.struct(
            F.lit(field).cast("string").alias("field"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
            l.cast("string").alias("left_value"),
            r.cast("string").alias("right_value"),
        )

    cells = []
    for c in cols:
        l, r = F.col(f"_left.`{c}`"), F.col(f"_right.`{c}`")
        if l_types[c] != r_types[c]:
            kind = F.when(~(l.isNull() & r.isNull()), "type")
        else:
            equal = num_equal(l, r) if l_types[c] == "number" else l == r
            kind = F.when(l.isNull() & r.isNull(), None).when(l.isNull() | r.isNull(), "type").when(~equal, "value")
        cells.append(F.when(kind.isNotNull(), found(c, kind, l, r)))
    no_text = F.lit(None).cast("string")
    rows = (
        F.when(F.col("_left").isNull(), F.array(found(None, "missing", no_text, no_text)))
        .when(F.col("_right").isNull(), F.array(found(None, "extra", no_text, no_text)))
        .otherwise(F.filter(F.array(*cells), lambda c: c.isNotNull()))
    )
    return both.select(*keys, F.explode(rows).alias("_d")).select(*keys, "_d.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys met more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _side_by_side(left: DataFrame, right: DataFrame, ids: Sequence[str], selected: DataFrame, value: Sequence[str]) -> DataFrame:
    """What a full outer join by ids and pointer gives of the documents in ``selected``, where ``right`` lacks some of ``ids``.

    All nodes move once, by the ids that both sides have, and meet ``selected`` there: it lends the right ones the ids they lack.
    What follows by all ids stays in place. A side that has a document twice tells by ``_unlike`` where the two are not the same.
    """
    shared = [c for c in ids if c in right.columns]
    # Rows are told apart at their end, by number and first id: so they take a fifth less when they move.
    cells = [*ids[1:], "ptr", "_left", *[c for c in value if c != "num"], "num", ids[0]]
    both = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)), allowMissingColumns=True).select(*cells)
    named = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in shared]
    own = [~F.col("_left") | (F.col(f"x.{c}") == F.col(f"y.{c}")) for c in ids if c not in shared]
    # A table's size tells little of its rows: none is to be broadcast.
    met = both.repartition(*shared).alias("x").join(selected.select(*ids).hint("merge").alias("y"), functools.reduce(Column.__and__, named + own))
    l, r = (F.when(side, F.struct(*value)) for side in (F.col("_left"), ~F.col("_left")))
    code = F.xxhash64("jtype", "size", "num", "str", "bool")
    codes = [F.when(side, code) for side in (F.col("_left"), ~F.col("_left"))]
    unlike = [F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in codes]
    return met.select(*[f"y.{c}" for c in ids], "ptr", "_left", *value).groupBy(*ids, "ptr").agg(F.max(l).alias("l"), F.max(r).alias("r"), (unlike[0] | unlike[1]).alias("_unlike"))


def diff_nodes(
    left: DataFrame, right: DataFrame, ids: Sequence[str], selected: DataFrame | None = None, roots: bool = False, placed: bool = True
) -> DataFrame:
    """Differences of two node tables, the topmost of each branch only.

    A missing subtree or a clash of types is one row with nothing beneath it. Arrays of unlike
    length give one ``length`` row, their shared prefix is still compared, their tails are not
    listed. Absent and null differ; null equals null.

    ``place`` and then the pointer give the order of differences within a document: the left document's; members the left
    lacks follow their parent's own, by code point. Objects of unlike names tell their children where they close, so the
    order takes no second look at the documents. ``placed=False`` leaves it out, and what only it takes is not moved.

    ``selected`` (some of ids) restricts the differences to documents it names; it meets what differs, not every node.
    Where ``right`` lacks some of ids, a document of it is expected of all that ``selected`` (all of ids, distinct) names.
    ``roots`` adds ``read``, true in one row for every document of which both sides have a root; that row has no kind where
    the roots do not differ.
    """
    on, value = [*ids, "ptr"], [c for c in VALUE if placed or c not in ("ord", "stop", "names")]
    spread = selected is not None and not set(ids) <= set(right.columns)
    if spread:
        aligned = _side_by_side(left, right, ids, selected, value)
    else:
        aligned = left.select(*on, F.struct(*value).alias("l")).join(right.select(*on, F.struct(*value).alias("r")), on, "full_outer")
        aligned = aligned.withColumn("_unlike", F.lit(False))
    l, r = F.col("l"), F.col("r")
    # Beneath a clash of types the two trails differ; beneath an absence the parent is absent too.
    apart = F.coalesce(l["trail"] != r["trail"], F.lit(False))
    kind = (
        F.when(l.isNull(), "missing")
        .when(r.isNull(), "extra")
        .when(l["jtype"] != r["jtype"], "type")
        .when((l["jtype"] == "number") & ~num_equal(l["num"], r["num"]), "value")
        .when((l["jtype"] == "string") & (l["str"] != r["str"]), "value")
        .when((l["jtype"] == "boolean") & (l["bool"] != r["bool"]), "value")
        .when((l["jtype"] == "array") & (l["size"] != r["size"]), "length")
        .when(F.col("_unlike"), "value")
    )
    tail = F.col("kind").isin("missing", "extra") & F.coalesce(l["trail"], r["trail"]).endswith("a")
    unlike_names = F.coalesce(l["names"] != r["names"], F.lit(False)) if placed else F.lit(False)
    read = (F.col("ptr") == "") & l.isNotNull() & r.isNotNull() if roots else F.lit(False)
    found = aligned.withColumns({"kind": kind, "_apart": apart, "_names": unlike_names, "read": read})
    found = found.where(F.col("kind").isNotNull() | apart | unlike_names | F.col("read"))

    def text(side: Column) -> Column:
        return (
            F.when(side["jtype"] == "number", side["num"].cast("string"))
            .when(side["jtype"] == "boolean", side["bool"].cast("string"))
            .when(side["jtype"] == "string", side["str"])
            .when(side["jtype"] == "array", F.concat(F.lit("array of "), side["size"].cast("string")))
            .when(side["jtype"] == "object", F.concat(F.lit("object of "), side["size"].cast("string")))
        )

    # What is told of a place is worked out before rows move, so that what is not asked for does not.
    told = {"left_type": l["jtype"], "right_type": r["jtype"], "left_value": text(l), "right_value": text(r)}
    own, stops = (l["ord"], l["stop"]) if placed else [F.lit(None).cast("long")] * 2
    found = found.withColumns({**told, "_tail": tail, "_ord": own, "_stops": stops}).drop("l", "r", "_unlike")
    if selected is not None and not spread:
        found = found.join(selected, selected.columns, "left_semi")
    stop = F.col("_apart") | F.coalesce(F.col("kind").isin("missing", "extra", "type"), F.lit(False))
    parent = (F.col("_names"), F.col("_stops")) if placed else None
    kept = topmost(found, ids, stop, parent).where((F.col("kind").isNotNull() & ~F.col("_apart") & ~F.col("_tail")) | F.col("read"))
    place = [F.coalesce("_ord", F.col("_told"), F.lit(AFTER_ALL)).alias("place")] if placed else []
    return kept.select(*on, "kind", *told, *place, *(["read"] if roots else []))


def order_diffs(diffs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Differences by document, and in each in their order."""
    return diffs.orderBy(*ids, "place", "ptr").drop("place")


def diff_arrays(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Ordered number arrays: one ``length`` row per key, and value rows in the shared prefix."""
    both = left.select(*keys, F.col(column).alias("_l")).join(right.select(*keys, F.col(column).alias("_r")), list(keys))
    shared = F.least(F.size("_l"), F.size("_r"))
    length = F.when(
        F.size("_l") != F.size("_r"),
        F.array(
            F.struct(
                F.lit("length").alias("kind"),
                F.lit(None).cast("int").alias("index"),
                F.size("_l").cast("double").alias("left_value"),
                F.size("_r").cast("double").alias("right_value"),
            )
        ),
    ).otherwise(F.array())
    values = F.filter(
        F.transform(
            F.arrays_zip(F.slice("_l", F.lit(1), shared).alias("l"), F.slice("_r", F.lit(1), shared).alias("r")),
            lambda pair, at: F.when(
                ~num_equal(pair["l"], pair["r"]),
                F.struct(
                    F.lit("value").alias("kind"),
                    at.alias("index"),
                    pair["l"].cast("double").alias("left_value"),
                    pair["r"].cast("double").alias("right_value"),
                ),
            ),
        ),
        lambda found: found.isNotNull(),
    )
    return both.select(*keys, F.explode(F.concat(length, values)).alias("_d")).select(*keys, "_d.*")


def pairing_key(df: DataFrame, cols: Sequence[str]) -> tuple[list[Column], Column]:
    """Columns to pair bag elements by, and whether a row can pair at all.

    Numbers become doubles, so 3 pairs with 3.0; minus zero becomes zero. A NaN or an infinity
    makes the whole element unpairable.
    """
    parts, pairable = [], F.lit(True)
    for c in cols:
        if _cell_type(df, c) == "number":
            number = F.col(c).cast("double")
            pairable = pairable & F.coalesce(is_finite(number), F.lit(True))
            parts.append((number + F.lit(0.0)).alias(c))
        else:
            parts.append(F.col(c))
    return parts, pairable


def multiset_diff(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bag difference: each unmatched element once, with its side and how often it is unmatched.

    Both bags are counted before they meet, so no element, however often it occurs, reaches a
    task as more than one row per side.
    """
    def count(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        parts, pairable = pairing_key(df, cols)
        keyed = df.select(*parts, pairable.alias("_pairable"))
        counted = keyed.groupBy(*cols, "_pairable").agg(F.count(F.lit(1)).alias(f"_n_{name}"))
        return counted.where("_pairable").drop("_pairable"), counted.where("NOT _pairable").drop("_pairable")

    (l, l_alone), (r, r_alone) = count(left, "l"), count(right, "r")
    r2 = r.select(*[F.col(c).alias(f"_r_{i}") for i, c in enumerate(cols)], "_n_r")
    same = [l[c].eqNullSafe(r2[f"_r_{i}"]) for i, c in enumerate(cols)]
    both = l.join(r2, same, "full_outer")
    surplus = F.coalesce("_n_l", F.lit(0)) - F.coalesce("_n_r", F.lit(0))
    paired = both.withColumn("_s", surplus).where("_s <> 0").select(
        F.when(F.col("_s") > 0, "left").otherwise("right").alias("side"),
        *[F.when(F.col("_s") > 0, l[c]).otherwise(r2[f"_r_{i}"]).alias(c) for i, c in enumerate(cols)],
        F.abs("_s").alias("n"),
    )
    alone = l_alone.select(F.lit("left").alias("side"), *cols, F.col("_n_l").alias("n")).unionByName(
        r_alone.select(F.lit("right").alias("side"), *cols, F.col("_n_r").alias("n"))
    )
    return paired.unionByName(alone)


def expand_bag(bag: DataFrame, chunk: int = 10_000) -> DataFrame:
    """One row per unmatched element. Large counts are cut in chunks that are spread out first."""
    rest = F.col("n") - F.col("_c") * chunk
    chunks = bag.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))))
    spread = chunks.withColumn("_take", F.least(F.lit(chunk), rest)).repartition(*bag.columns, "_c")
    return spread.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_take").cast("int")))).withColumn(
        "copy", F.col("_c").cast("long") * chunk + F.col("copy")
    ).drop("_c", "_take", "n")


def total_and_first(diffs: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group and the group's total.

    Totals are a partial aggregation; the rank filter is applied before its shuffle, so a group of
    any size sends at most ``n`` rows per task.
    """
    totals = diffs.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    ranked = diffs.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= n).join(totals, list(group))


def diff_outcome(both: DataFrame, keys: Sequence[str], declared: str, observed: str) -> DataFrame:
    """One ``value`` row where the observed outcome is not the declared one."""
    return both.where(F.col(declared) != F.col(observed)).select(
        *keys, F.lit("value").alias("kind"), F.col(observed).alias("left_value"), F.col(declared).alias("right_value")
    )


def diff_sequence(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str]) -> DataFrame:
    """Sequences position by position: same members in other places differ, lengths count."""
    on = [*keys, pos]
    l = left.select(*on, F.struct(*cols).alias("_l"))
    r = right.select(*on, F.struct(*cols).alias("_r"))
    sizes = (
        left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
        .join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")), list(keys))
        .where("_nl <> _nr")
        .select(*keys, F.lit(None).cast("long").alias(pos), F.lit("length").alias("kind"),
                F.col("_nl").cast("string").alias("left_value"), F.col("_nr").cast("string").alias("right_value"))
    )
    def text(side: str) -> Column:
        return F.concat_ws("|", *[F.coalesce(F.col(f"{side}.`{c}`").cast("string"), F.lit("null")) for c in cols])

    unlike = (
        l.join(r, on)
        .where(~F.col("_l").eqNullSafe(F.col("_r")))
        .select(*keys, F.col(pos).cast("long").alias(pos), F.lit("value").alias("kind"),
                text("_l").alias("left_value"), text("_r").alias("right_value"))
    )
    return unlike.unionByName(sizes)


def merge_spans(spans: DataFrame, group: Sequence[str], start: str, end: str, length: str | None = None, rows: int = 1_000_000) -> DataFrame:
    """Spans clamped to their text, empty ones dropped, overlapping or touching ones merged.

    Spans are moved once: each block of a group (``data_blocks``) merges its own, in one order and without a table of islands.
    What is left of a block meets one row of totals of the blocks before it: their furthest end, and the island opened there
    last. The islands of a block that begin within that reach are its first ones, so they belong to that island.
    """
    group = list(group)
    s, e = F.col(start), F.col(end)
    kept = spans.where(e > s)
    if length is not None:
        s, e = F.greatest(F.lit(0), F.least(s, F.col(length))), F.greatest(F.lit(0), F.least(e, F.col(length)))
    # A clamped span may be empty now; it is kept because it may still touch a neighbour's end.
    cut = data_blocks(kept.select(*group, s.alias("_s"), e.alias("_e")), group, "_s", rows)
    inside = Window.partitionBy(*group, "_block").orderBy("_s")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opened = cut.withColumns({"_opens": F.when(reach.isNull() | (F.col("_s") > reach), F.col("_s")), "_upto": F.max("_e").over(so_far)})
    # An island ends before the next one opens, and no end before it is further.
    ends = opened.withColumns({"_island": F.max("_opens").over(so_far), "_ends": F.lead(F.col("_opens").isNotNull(), 1, True).over(inside)})
    parts = ends.where("_ends").select(*group, "_block", F.col("_island").alias("_s"), F.col("_upto").alias("_e"))

    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*group, "_block").agg(F.max("_s").alias("_s"), F.max("_e").alias("_e")).withColumn("_reach", F.max("_e").over(before))
    # If a block's last island does not open, none of it does.
    last = F.max(F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach")), F.col("_s"))).over(before)
    carried = totals.withColumn("_last", last).where("_reach IS NOT NULL").drop("_s", "_e")
    same = functools.reduce(Column.__and__, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*group, "_block"]])
    placed = parts.alias("x").join(carried.alias("y"), same, "left")
    island = F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach")), F.col("_s")).otherwise(F.col("_last"))
    return placed.select("x.*", island.alias("_island")).groupBy(*group, F.col("_island").alias(start)).agg(F.max("_e").alias(end))
