"""Ordered changes to the named records of many documents: set-field, update, add, remove and rename."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.skew import blocked_running, spread_join
from concord.session import durable

#: The place in the list of what is there before the first change.
BASE = -(2**62)


def _same(left: str, right: str, cols: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in cols:
        condition = condition & (F.col(f"{left}.{c}") == F.col(f"{right}.{c}"))
    return condition


def _before(events: DataFrame, scope: Sequence[str], value: Column, out: str, width: int | None) -> DataFrame:
    """Adds the newest non-null ``value`` among the earlier events of the same name, in blocks of ``width`` places of the list
    (none: no name has so many events that it needs them)."""
    if width is None:
        earlier = Window.partitionBy(*scope, "place").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        return events.withColumn(out, F.last(value, ignorenulls=True).over(earlier))
    newest = F.when(value.isNotNull(), F.struct(F.col("seq"), value.alias("v")))
    seen = blocked_running(events, [*scope, "place"], [F.col("seq")], F.floor(F.col("seq") / F.lit(width)), {"_newest": ("max", newest, False)})
    return seen.withColumn(out, F.col("_newest.v")).drop("_newest")


def _holds() -> Column:
    """Whether an event leaves its name held, if the renames marked ``moves`` are those that take effect; null where it changes nothing."""
    moves = F.col("moves")
    given = F.col("op").isin("base", "add") | (F.col("half") == "in") & moves
    return F.when(given, True).when((F.col("op") == "remove") | (F.col("half") == "out") & moves, False)


def _judge(events: DataFrame, scope: Sequence[str], width: int | None) -> DataFrame:
    """(scope, seq, effect): which changes find what they name, if the renames marked ``moves`` are those that take effect."""
    seen = _before(events, scope, _holds(), "_held", width).where("op <> 'base'").withColumn("_held", F.coalesce("_held", F.lit(False)))
    # A change has one op; as a key it leaves only truth values to combine, which need no sort.
    both = seen.groupBy(*scope, "seq", "op").agg(
        F.max(F.when(F.col("half") == "out", F.col("_held"))).alias("_held"),
        F.max(F.when(F.col("half") == "in", F.col("_held"))).alias("_taken"),
    )
    effect = F.when(F.col("op") == "add", ~F.col("_held")).otherwise(F.col("_held") & ~F.coalesce("_taken", F.lit(False)))
    return both.select(*scope, "seq", effect.alias("effect"))


def _roots(links: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, start, up_place, up_start): for each name that a rename gave, the name that its object had at first.

    Links are followed by doubling, so a chain of n renames takes log2(n) steps.
    """
    links = durable(links)
    while True:
        on = _same("a", "b", scope) & (F.col("a.up_start") == F.col("b.start"))
        longer = links.alias("a").join(links.alias("b"), on, "left").select(
            *[F.col(f"a.{c}").alias(c) for c in [*scope, "start"]],
            F.coalesce("b.up_place", "a.up_place").alias("up_place"), F.coalesce("b.up_start", "a.up_start").alias("up_start"),
            F.col("b.start").isNotNull().alias("_moved"),
        )
        longer = durable(longer)
        if longer.where("_moved").isEmpty():
            return longer.drop("_moved")
        links = longer.drop("_moved")


def apply_changes(
    df: DataFrame, ops: DataFrame, scope: Sequence[str], name: str, columns: Mapping[str, str], width: int = 1_000_000
) -> tuple[DataFrame, DataFrame]:
    """Records after the changes of their document, and the changes that took no effect.

    ``ops`` has (scope, seq, op, name, field, value, to), ``scope`` the columns that tell documents apart. The changes of a
    document apply in the order of ``seq``, each to what the earlier ones left; the fields of one add or update are rows of
    one seq. Names are met in any casing and kept as spelled. ``columns`` maps a column to its type; values are text.

    A rename's ``to`` is the object's name from then on: later changes must use it, and its old name is free. An update
    applies whole or not at all. Returned are (scope, name, columns), and the rows of ``ops`` with ``reason``:

    - ``no object``: it names what is not held where it stands in the list; also a null scope, seq or name
    - ``exists``: an add, or a rename to, a name that is held. A rename that only changes the casing is none
    - ``unknown op``; ``unknown field``, the name among them; ``unreadable``, for a value that is none of the column's type
    - ``group refused``: entries of an update that another of its entries refuses

    The field of an add that is refused is left null; the object is added. Records of one document that share a name change
    together. Null names and null scopes are met by no change and stay.

    Which names are held depends on which renames took effect. All are first taken to; each round judges every change by
    the state that the last round's renames leave, and it ends when no rename's verdict changes. A verdict depends on
    earlier changes only, so the end is the result of going through the list one by one. Rounds grow with chains of
    refused renames that hang on each other, not with the length of the list or with chains of renames that apply.
    Records that no change names meet one join and stay. Names of at most ``width`` events are judged in one window each.
    """
    scope = list(scope)
    known = F.col("op").isin("set-field", "update", "add", "remove", "rename") & F.col(name).isNotNull() & F.col("seq").isNotNull()
    known = known & ((F.col("op") != "rename") | F.col("to").isNotNull())
    for c in scope:
        known = known & F.col(c).isNotNull()
    heads = ops.where(known).groupBy(*scope, "seq").agg(F.min("op").alias("op"), F.min(F.lower(name)).alias("_from"), F.min("to").alias("to"))
    heads = heads.withColumn("seq", F.col("seq").cast("long"))
    aside = F.lower("to")
    half = lambda place, side: F.struct(place.alias("place"), F.lit(side).alias("half"))
    out = half(F.col("_from"), "out")
    halves = F.when((F.col("op") == "rename") & (aside != F.col("_from")), F.array(out, half(aside, "in"))).otherwise(F.array(out))
    acts = heads.select(*scope, "seq", "op", "to", F.explode(halves).alias("_h")).select(*scope, "_h.place", "seq", "op", "_h.half", "to")
    # A change of casing moves nothing.
    acts = durable(acts.withColumn("moves", (F.col("op") == "rename") & ((F.col("half") == "in") | (F.lower("to") != F.col("place")))))
    named = df.select(*scope, F.lower(name).alias("place")).where("place IS NOT NULL").distinct()
    base = named.join(acts.select(*scope, "place").distinct(), [*scope, "place"], "left_semi")
    start = base.selectExpr(*[f"`{c}`" for c in scope], "place", f"{BASE}L AS seq", "'base' AS op", "'out' AS half", "CAST(NULL AS STRING) AS to", "false AS moves")
    events = durable(start.unionByName(acts))

    # Which events a name has stays the same from round to round: only a list that names one very often is cut into blocks.
    if events.groupBy(*scope, "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > width).isEmpty():
        width = None

    # Only what gives or frees a name decides the state.
    while True:
        state = events.where("op NOT IN ('set-field', 'update')")
        verdict = _judge(state, scope, width).select(*[F.col(c).alias(f"_{c}") for c in scope], F.col("seq").alias("_seq"), "effect")
        on = events["seq"] == verdict["_seq"]
        for c in scope:
            on = on & (events[c] == verdict[f"_{c}"])
        moves = F.when((F.col("op") == "rename") & F.col("_can_move"), F.col("effect")).otherwise(F.col("moves"))
        judged = events.withColumn("_can_move", (F.col("half") == "in") | (F.lower("to") != F.col("place"))).join(verdict, on, "left")
        judged = durable(judged.withColumn("_now", moves).select(*events.columns, "_now"))
        settled = judged.where("moves <> _now").isEmpty()
        events = judged.withColumn("moves", F.col("_now")).drop("_now")
        if settled:
            break
    verdict = durable(_judge(events, scope, width))

    # Each name is held in tenures; a change meets the newest one that began before it.
    judged = spread_join(events, verdict, [*scope, "seq"])
    begins = (F.col("op") == "base") | (F.col("op") == "add") & F.col("effect") | (F.col("half") == "in") & F.col("moves")
    met = _before(judged, scope, F.when(begins, F.col("seq")), "_met", width).where("effect AND half = 'out'")
    met = met.withColumn("start", F.when(F.col("op") == "add", F.col("seq")).otherwise(F.col("_met"))).select(*scope, "place", "start", "seq", "op", "to", "moves")
    met = durable(met)
    up = _roots(met.where("moves").select(*scope, F.col("seq").alias("start"), F.col("place").alias("up_place"), F.col("start").alias("up_start")), scope)
    met = spread_join(met, up, [*scope, "start"]).select(
        *scope, "seq", "op", "to", F.coalesce("up_place", "place").alias("place"), F.coalesce("up_start", "start").alias("start")
    )

    # Entries that hold a field, judged one by one; an update by all of its own.
    entries = ops.withColumn("_seq", F.col("seq").cast("long"))
    writes = F.col("op").isin("set-field", "update", "add") & F.col("field").isNotNull()
    fault = F.when(writes & ~F.col("field").isin(*columns), "unknown field")
    for c, kind in columns.items():
        fault = fault.when(writes & (F.col("field") == c) & F.col("value").isNotNull() & F.col("value").try_cast(kind).isNull(), "unreadable")
    entries = entries.withColumn("_fault", fault)
    bad = entries.where("op = 'update' AND _fault IS NOT NULL").select(*scope, "_seq").distinct().withColumn("_refused", F.lit(True))
    entries = spread_join(entries, bad, [*scope, "_seq"])
    entries = spread_join(entries, verdict.withColumnRenamed("seq", "_seq"), [*scope, "_seq"])
    missing = F.when(F.col("op").isin("set-field", "update", "add", "remove", "rename"), F.lit(None)).otherwise("unknown op")
    unmet = F.when(F.col("effect").isNull(), "no object").when(~F.col("effect"), F.when(F.col("op") == "add", "exists").otherwise(F.lit("no object")))
    reason = F.coalesce(missing, unmet, "_fault", F.when(F.col("_refused"), "group refused"))
    # A rename is refused for what it names first, then for what it wants to be.
    held = _before(events, scope, _holds(), "_h", width)
    blocked = held.where("op = 'rename' AND half = 'out' AND _h").select(*scope, F.col("seq").alias("_seq"), F.lit(True).alias("_source"))
    entries = spread_join(entries, blocked, [*scope, "_seq"])
    reason = F.when((F.col("op") == "rename") & F.col("_source") & ~F.col("effect"), "exists").otherwise(reason)
    entries = durable(entries.withColumn("reason", reason))
    rejects = entries.where("reason IS NOT NULL").select(*ops.columns, "reason")

    good = entries.where("reason IS NULL").select(*scope, F.col("_seq").alias("seq"), F.col(name).alias("_spelled"), "field", "value")
    done = spread_join(good, met.select(*scope, "seq", "op", "to", "place", "start"), [*scope, "seq"], "inner")
    # A refused field of an add leaves the object: its head counts even if no entry does.
    heads_of = spread_join(met.where("op = 'add'"), ops.where("op = 'add'").groupBy(*scope, F.col("seq").cast("long").alias("seq")).agg(F.min(name).alias("_spelled")), [*scope, "seq"])
    done = done.unionByName(heads_of.select(*scope, "seq", "_spelled", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), "op", "to", "place", "start"))
    writes = F.col("op").isin("set-field", "update", "add")
    fate = done.groupBy(*scope, "place", "start").agg(
        F.max(F.col("op") == "remove").alias("_gone"),
        F.max(F.when(F.col("op").isin("add", "rename"), F.struct("seq", F.coalesce("to", "_spelled").alias("v")))).alias("_name"),
        *[F.max(F.when(writes & (F.col("field") == c), F.struct("seq", "value"))).alias(f"_set_{c}") for c in columns],
    )
    fate = durable(fate)
    value = lambda c, kind, old: F.when(F.col(f"_set_{c}").isNotNull(), F.col(f"_set_{c}.value").try_cast(kind)).otherwise(old).alias(c)
    rows = df.select(*scope, name, *columns, F.lower(name).alias("place"))
    old = spread_join(rows, fate.where(F.col("start") == BASE).drop("start"), [*scope, "place"]).where(~F.coalesce("_gone", F.lit(False)))
    old = old.select(*scope, F.coalesce("_name.v", name).alias(name), *[value(c, kind, F.col(c)) for c, kind in columns.items()])
    new = fate.where((F.col("start") != BASE) & ~F.col("_gone"))
    new = new.select(*scope, F.col("_name.v").alias(name), *[value(c, kind, F.lit(None).cast(kind)) for c, kind in columns.items()])
    return old.unionByName(new), rejects
