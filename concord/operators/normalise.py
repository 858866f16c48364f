"""Positional text records to typed, keyed records, directed by a dictionary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.numbers import read_number
from concord.functions.versions import version_numbers
from concord.operators.skew import blocked_number, lookup_join, spread_join

# Keywords that may stand in a numeric field.
SENTINELS = ("autosize", "autocalculate")


def synthetic_key(df: DataFrame, model: Sequence[str], obj_type: str, order: str, rows: int = 1_000_000) -> DataFrame:
    """Adds ``synthetic``: ``<Type> N``, counted from 1 in file order within model and type."""
    numbered = blocked_number(df, [*model, obj_type], order, "_n", rows)
    return numbered.withColumn("synthetic", F.concat_ws(" ", F.col(obj_type), F.col("_n").cast("string"))).drop("_n")


def object_key(df: DataFrame, model: Sequence[str], obj_type: str, order: str, has_name: str, name: str, rows: int = 1_000_000) -> DataFrame:
    """Adds ``key``: the written name where the type has a name field, blank names included;
    the synthetic key elsewhere. A type without a name field never takes part in naming."""
    nameless = synthetic_key(df.where(~F.col(has_name)), model, obj_type, order, rows)
    named = df.where(F.col(has_name)).withColumn("synthetic", F.lit(None).cast("string"))
    return nameless.unionByName(named).withColumn(
        "key", F.when(F.col(has_name), F.coalesce(F.col(name), F.lit(""))).otherwise(F.col("synthetic"))
    ).drop("synthetic")


def drop_unset(fields: DataFrame, value: str = "raw") -> DataFrame:
    """Fields that say something. Blank and truncated slots are the same; zero is a value."""
    return fields.where(F.trim(F.coalesce(F.col(value), F.lit(""))) != "")


def fold_groups(fields: DataFrame, keys: Sequence[str], pos: str, value: str, fixed: int, members: Sequence[str]) -> DataFrame:
    """Slots after the ``fixed`` ones as rows (keys, group, one column per member).

    The last group may be partial: what it lacks stays null. An object with no slot has no row.
    A group has as many members as the dictionary says, so no row grows with the data.
    """
    at = F.col(pos) - fixed
    slots = drop_unset(fields.where(at >= 0), value)
    member = F.pmod(at, F.lit(len(members)))
    return slots.groupBy(*keys, F.floor(at / len(members)).alias("group")).agg(
        *[F.max(F.when(member == i, F.col(value))).alias(m) for i, m in enumerate(members)]
    )


def wrapper_keys(groups: DataFrame, dictionary: DataFrame, obj_type: str) -> DataFrame:
    """Adds ``wrapper``, the name of the repeated list: the dictionary's, never a field's."""
    names = dictionary.select(F.col("obj_type").alias(obj_type), F.col("ext_key").alias("wrapper"))
    return lookup_join(groups, names, [obj_type])


def coerce(value: Column, numeric: Column, integer: Column) -> Column:
    """A text as what its field allows: struct(num, int, str) with one part set.

    Only numeric or integer fields read numbers; text that is no number stays text; whole numbers
    only where the field is integer and not number.
    """
    number = F.when(numeric | integer, read_number(value))
    whole = integer & ~numeric
    return F.struct(
        F.when(~whole, number).alias("num"),
        F.when(whole, number.cast("long")).alias("int"),
        F.when(number.isNull(), value).alias("str"),
    )


def canon_spelling(df: DataFrame, spellings: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the dictionary's spelling of a value met in any casing, else the value itself.

    ``spellings`` has ``keys`` and ``spelling``. Used for choices, sentinels and type names.
    """
    spelled = _dictionary_spelling(df, spellings, keys, value)
    return spelled.withColumn(out, F.coalesce("_spelling", value)).drop("_spelling")


def _dictionary_spelling(df: DataFrame, spellings: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    names = spellings.groupBy(*keys, F.lower("spelling").alias("_folded")).agg(F.min("spelling").alias("_spelling"))
    return lookup_join(df.withColumn("_folded", F.lower(value)), names, [*keys, "_folded"]).drop("_folded")


def canon_sentinel(df: DataFrame, spellings: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``canon_spelling``, and a numeric keyword the field's dictionary does not know becomes the
    keyword it does name."""
    keywords = (
        spellings.where(F.lower("spelling").isin(*SENTINELS)).groupBy(*keys).agg(F.min("spelling").alias("_keyword"))
    )
    joined = lookup_join(_dictionary_spelling(df, spellings, keys, value), keywords, keys)
    keyword = F.when(F.lower(value).isin(*SENTINELS), F.col("_keyword"))
    return joined.withColumn(out, F.coalesce("_spelling", keyword, value)).drop("_spelling", "_keyword")


def resolve_version(df: DataFrame, version: str, dictionaries: DataFrame, out: str = "dictionary") -> DataFrame:
    """Adds the dictionary of a version: the exact one, else the newest of its major.minor.

    Never the closest earlier one: a version with no dictionary of its own minor has none.
    """
    dims = dictionaries.withColumn("_v", version_numbers(F.col("version"))).select(
        F.col("version").alias("_name"), F.get("_v", F.lit(0)).alias("_major"), F.get("_v", F.lit(1)).alias("_minor"), F.get("_v", F.lit(2)).alias("_patch")
    )
    exact = dims.groupBy("_major", "_minor", "_patch").agg(F.min("_name").alias("_exact"))
    newest = dims.groupBy("_major", "_minor").agg(F.max_by("_name", "_patch").alias("_newest"))
    numbers = version_numbers(F.col(version))
    placed = df.withColumns({"_major": F.get(numbers, F.lit(0)), "_minor": F.get(numbers, F.lit(1)), "_patch": F.get(numbers, F.lit(2))})
    joined = lookup_join(lookup_join(placed, exact, ["_major", "_minor", "_patch"]), newest, ["_major", "_minor"])
    return joined.withColumn(out, F.coalesce("_exact", "_newest")).drop("_major", "_minor", "_patch", "_exact", "_newest")


def model_version(fields: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The version statement of each file, wherever it stands, as spelled."""
    return (
        fields.where((F.lower("obj_type") == "version") & (F.col("pos") == 0))
        .groupBy(*ids)
        .agg(F.min_by("raw", "seq").alias("version"))
    )


def unknown_types(statements: DataFrame, known: DataFrame, obj_type: str = "obj_type") -> DataFrame:
    """Statements whose type the dictionary lacks: every one, not every distinct type."""
    names = known.select(F.lower("obj_type").alias("_folded")).distinct()
    return lookup_join(statements.withColumn("_folded", F.lower(obj_type)), names, ["_folded"], "left_anti").drop("_folded")


def first_unknown_type(unknown: DataFrame, ids: Sequence[str], line: str, obj_type: str) -> DataFrame:
    """The one finding of a reader that stops at the first: lowest line of each file."""
    return unknown.groupBy(*ids).agg(F.min(F.struct(line, obj_type)).alias("_f")).select(*ids, "_f.*")


def lookup(df: DataFrame, group: str, name: str, order: str, queries: DataFrame, query: str = "query", scope: Sequence[str] = ()) -> DataFrame:
    """Names of a collection asked for in any casing: rows (scope, query, present, order, name).

    One row per name, so a collection of any size is never one row; a query that meets nothing
    keeps one row with ``present`` false. The collection itself is not touched. ``scope`` are the columns of both tables that
    tell documents apart: a query sees the collections of its own document only.
    """
    on = [*scope, "_folded"]
    asked = queries.select(*scope, query, F.lower(query).alias("_folded"))
    members = df.select(*scope, F.lower(group).alias("_folded"), F.col(order), F.col(name))
    joined = spread_join(members, asked, on, "inner") if scope else lookup_join(members, asked, on, "inner")
    hits = joined.select(*scope, query, F.lit(True).alias("present"), order, name)
    met = df.select(*scope, F.lower(group).alias("_folded")).distinct()
    misses = asked.join(met, on, "left_anti").select(
        *scope, query, F.lit(False).alias("present"), F.lit(None).cast(dict(df.dtypes)[order]).alias(order), F.lit(None).cast("string").alias(name)
    )
    return hits.unionByName(misses)


def resolve_refs(refs: DataFrame, ref: str, names: DataFrame, name: str, out: str = "target", scope: Sequence[str] = ()) -> DataFrame:
    """Adds the name a reference meets in any casing; both spellings stay as they are.

    Dangling references keep a null target; an object may refer to itself. ``scope`` are the columns of both tables that tell
    documents apart: a reference meets names of its own document only.
    """
    declared = names.groupBy(*scope, F.lower(name).alias("_folded")).agg(F.min(name).alias(out))
    return spread_join(refs.withColumn("_folded", F.lower(ref)), declared, [*scope, "_folded"]).drop("_folded")


def rename_refs(refs: DataFrame, ref: str, renames: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """References follow renamed objects (``old`` to ``new``), matched in any casing, each within its document (``scope``)."""
    moved = renames.groupBy(*scope, F.lower("old").alias("_folded")).agg(F.min("new").alias("_new"))
    joined = spread_join(refs.withColumn("_folded", F.lower(ref)), moved, [*scope, "_folded"])
    return joined.withColumn(ref, F.coalesce("_new", ref)).drop("_folded", "_new")


def _readable(kind: str) -> Column:
    return F.col("value").isNull() | F.col("value").try_cast(kind).isNotNull()


def apply_patches(df: DataFrame, ops: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Records after a list of changes, applied in the order of ``seq``.

    ``ops`` has (seq, op, key, field, value) with op ``set-field``, ``add`` or ``remove``; the
    fields of one add share its seq. ``columns`` maps a column to its type; values are text. What
    counts is the last remove, the last add and the last readable setting of each field, so the list is
    reduced to one row per key by a partial aggregation before it meets the records. Changes that
    take no effect are the rows of ``patch_rejects``.
    """
    setting = F.col("op").isin("set-field", "add")
    last = ops.groupBy(key).agg(
        F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("_removed"),
        F.max(F.when(F.col("op") == "add", F.col("seq"))).alias("_added"),
        *[F.max(F.when(setting & (F.col("field") == c) & _readable(kind), F.struct("seq", "value"))).alias(f"_set_{c}") for c, kind in columns.items()],
    )
    base = df.select(key, *columns, F.lit(True).alias("_base"))
    both = base.join(last, key, "full_outer")
    removed, added = F.coalesce("_removed", F.lit(-1)), F.coalesce("_added", F.lit(-1))
    fresh = added >= 0
    alive = F.when(removed > added, F.lit(False)).otherwise(fresh | F.coalesce("_base", F.lit(False)))

    def value(c: str, kind: str) -> Column:
        newest = F.col(f"_set_{c}")
        applies = newest.isNotNull() & (newest["seq"] > removed) & (newest["seq"] >= added)
        return F.when(applies, newest["value"].try_cast(kind)).when(~fresh & (removed < 0), F.col(c)).alias(c)

    return both.where(alive).select(key, *[value(c, kind) for c, kind in columns.items()])


def patch_rejects(df: DataFrame, ops: DataFrame, key: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Changes of a list that take no effect, with the reason, each judged where it stands in the list.

    ``no object``: a setting or removal of what is not held, or no longer. ``exists``: an addition of what is held.
    With ``columns``: ``unknown field``, and ``unreadable`` for a value that is none of the column's type.
    """
    before = Window.partitionBy(key).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    turned = F.max(F.when(F.col("op").isin("add", "remove"), F.struct("seq", (F.col("op") == "add").alias("held")))).over(before)
    held = df.select(key).distinct().withColumn("_held", F.lit(True))
    judged = ops.withColumn("_turned", turned).join(held, key, "left").withColumn("_alive", F.coalesce(F.col("_turned.held"), "_held", F.lit(False)))
    reason = F.when(F.col("op").isin("set-field", "remove") & ~F.col("_alive"), "no object").when((F.col("op") == "add") & F.col("_alive"), "exists")
    if columns is not None:
        sets = F.col("op").isin("set-field", "add") & F.col("field").isNotNull()
        reason = reason.when(sets & ~F.col("field").isin(*columns), "unknown field")
        for c, kind in columns.items():
            reason = reason.when(sets & (F.col("field") == c) & ~_readable(kind), "unreadable")
    return judged.select(*ops.columns, reason.alias("reason")).where("reason IS NOT NULL")

def judge_updates(ops: DataFrame, fields: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Split a list of grouped updates: entries of groups that apply, and refused entries.

    One refused entry refuses its whole group. ``ops`` has (group, key, field, member, value);
    ``fields`` has (field, member, is_name), member null for plain fields. Refused are unknown
    fields, unknown members of a wrapper list, and the name field.
    """
    known = fields.select("field", F.coalesce("member", F.lit("")).alias("_member"), "is_name").distinct()
    judged = lookup_join(ops.withColumn("_member", F.coalesce("member", F.lit(""))), known, ["field", "_member"]).drop("_member")
    reason = F.when(F.col("is_name").isNull(), "unknown").when(F.col("is_name"), "name field")
    judged = judged.withColumn("reason", reason).drop("is_name")
    refused_groups = judged.where(F.col("reason").isNotNull()).select(group).distinct()
    applied = spread_join(judged, refused_groups, [group], "left_anti").drop("reason")
    return applied, judged.where(F.col("reason").isNotNull())
