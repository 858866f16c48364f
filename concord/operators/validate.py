"""Validation of values against a dictionary. At most one finding per value.

Values are long-form rows (object type, object name, field, jtype, num, str). A dictionary row has
(obj_type, field, required, branches, object_list, reference), where a branch is
struct(type, enum, min, max, xmin, xmax) and a plain field has one branch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.compare import multiset_diff
from concord.operators.skew import lookup_join, spread_join

BRANCHES = "array<struct<type:string,enum:array<string>,min:double,max:double,xmin:double,xmax:double>>"

FINDING = ["object_type", "object_name", "field", "code", "severity"]


def bounds(limit: Column, exclusive: Column) -> tuple[Column, Column]:
    """The inclusive and the exclusive bound that a pair of dictionary entries states.

    Old dictionaries qualify the bound by a boolean, new ones write the exclusive bound itself;
    which of the two is read off the value (JSON text), never off the version.
    """
    flag = F.coalesce(exclusive == "true", F.lit(False))
    number = F.when(~exclusive.isin("true", "false"), exclusive.try_cast("double"))
    return F.when(~flag, limit), F.when(flag, limit).otherwise(number)


def _satisfies_type(branch: Column, jtype: Column, num: Column) -> Column:
    return (
        F.when(branch["type"] == "number", jtype == "number")
        .when(branch["type"] == "integer", (jtype == "number") & (num == F.floor(num)))
        .otherwise(jtype == branch["type"])
    )


def _failure(branch: Column, jtype: Column, num: Column, text: Column) -> Column:
    """The most specific failure of a branch whose type fits, or null."""
    listed = F.exists(
        branch["enum"],
        lambda e: F.when(jtype == "string", F.lower(e) == F.lower(text)).otherwise(e.try_cast("double") == num),
    )
    number = jtype == "number"
    return (
        F.when(branch["enum"].isNotNull() & ~F.coalesce(listed, F.lit(False)), "E004")
        .when(number & (num < branch["min"]), "E005")
        .when(number & (num <= branch["xmin"]), "E006")
        .when(number & (num > branch["max"]), "E007")
        .when(number & (num >= branch["xmax"]), "E008")
    )


def value_code(branches: Column, jtype: Column, num: Column, text: Column) -> Column:
    """The code a value earns under its branches, or null when it is valid.

    Valid is a value that fully satisfies one branch. No branch of its type: ``E002`` (one branch:
    ``E003``). Otherwise the first branch of its type names the failure.
    """
    fitting = F.filter(branches, lambda b: F.coalesce(_satisfies_type(b, jtype, num), F.lit(False)))
    codes = F.transform(fitting, lambda b: F.coalesce(_failure(b, jtype, num, text), F.lit("")))
    return (
        F.when(F.coalesce(F.size(branches), F.lit(0)) <= 0, None)  # no branch, no rule
        .when(F.size(codes) == 0, F.when(F.size(branches) > 1, "E002").otherwise("E003"))
        .when(F.array_contains(codes, ""), None)
        .otherwise(F.get(codes, F.lit(0)))
    )


def _written(values: DataFrame) -> DataFrame:
    """Values that say something; a blank or absent field only counts for ``E001``."""
    return values.where((F.col("jtype") != "null") & ~((F.col("jtype") == "string") & (F.trim("str") == "")))


def _finding(df: DataFrame, code: Column, field: Column, severity: str = "error", model: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *model, "object_type", "object_name", field.cast("string").alias("field"), code.alias("code"), F.lit(severity).alias("severity")
    )


def check_values(values: DataFrame, dictionary: DataFrame, model: Sequence[str] = ()) -> DataFrame:
    """``E002`` to ``E008``: type, permitted values and bounds. Fields without an entry pass.

    Here and below ``model`` names the columns that tell documents apart: a finding keeps them, and nothing of one
    document counts for another. Without them all rows are one document.
    """
    entries = dictionary.select(F.col("obj_type").alias("object_type"), "field", "branches")
    judged = lookup_join(_written(values), entries, ["object_type", "field"], "inner")
    code = value_code(F.col("branches"), F.col("jtype"), F.col("num"), F.col("str"))
    return _finding(judged.withColumn("code", code).where("code IS NOT NULL"), F.col("code"), F.col("field"), model=model)


def check_required(objects: DataFrame, values: DataFrame, dictionary: DataFrame, model: Sequence[str] = ()) -> DataFrame:
    """``E001``: required fields that are missing or blank."""
    needed = dictionary.where("required").groupBy(F.col("obj_type").alias("object_type")).agg(F.collect_set("field").alias("_needed"))
    # A type has as many required fields as its dictionary entry: the exploded set is no group of data.
    expected = lookup_join(objects.select(*model, "object_type", "object_name"), needed, ["object_type"], "inner").select(
        *model, "object_type", "object_name", F.explode("_needed").alias("field")
    )
    place = [*model, "object_type", "object_name", "field"]
    # An anti-join asks for no distinct rows; a table of them would hold all values of a task. Both sides grow with the data, and
    # repeated names shrink so well that their shuffled size would pass for one to broadcast.
    missing = expected.join(_written(values).select(*place).hint("merge"), place, "left_anti")
    return _finding(missing, F.lit("E001"), F.col("field"), model=model)


def reference_names(values: DataFrame, dictionary: DataFrame, model: Sequence[str] = ()) -> DataFrame:
    """Distinct (list, folded name) that any field of any level contributes."""
    contributes = dictionary.where("size(reference) > 0").select(F.col("obj_type").alias("object_type"), "field", "reference")
    named = lookup_join(_written(values), contributes, ["object_type", "field"], "inner")
    return named.select(*model, F.explode("reference").alias("list"), F.lower("str").alias("name")).distinct()


def check_references(values: DataFrame, dictionary: DataFrame, names: DataFrame | None = None, model: Sequence[str] = ()) -> DataFrame:
    """``E009``: pointers at names that no object declares in any of the field's lists.

    Values of repeated groups are rows like any other. A field that points into a list nothing can
    contribute to (it names types, not objects) is exempt. Names meet pointers in one join, in which
    a name that any share of the rows refers to is spread.
    """
    names = reference_names(values, dictionary, model) if names is None else names
    lists = dictionary.where("size(object_list) > 0").select(F.col("obj_type").alias("object_type"), "field", F.explode("object_list").alias("list"))
    fed = dictionary.select(F.explode("reference").alias("list")).distinct()
    open_fields = lists.join(fed, "list", "left_anti").select("object_type", "field").distinct()
    closed = lists.join(open_fields, ["object_type", "field"], "left_anti")
    # Both sets are at most the lists of the dictionary.
    pointing = closed.groupBy("object_type", "field").agg(F.collect_set("list").alias("lists"))
    declared = names.groupBy(*model, "name").agg(F.collect_set("list").alias("_declared"))
    rows = lookup_join(_written(values), pointing, ["object_type", "field"], "inner").withColumn("name", F.lower("str"))
    met = F.coalesce(F.arrays_overlap("lists", "_declared"), F.lit(False))
    found = spread_join(rows, declared, [*model, "name"], "left").where(~met)
    return _finding(found, F.lit("E009"), F.col("field"), model=model)


def check_singleton(objects: DataFrame, model: Sequence[str], singletons: DataFrame) -> DataFrame:
    """``E010``: one finding per model and type that must be single and is not."""
    many = objects.groupBy(*model, "object_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return lookup_join(many, singletons.select(F.col("obj_type").alias("object_type")), ["object_type"], "left_semi")


def check_unknown(objects: DataFrame, values: DataFrame, dictionary: DataFrame, model: Sequence[str] = ()) -> DataFrame:
    """``W002`` unknown types, one per object, and ``W003`` unknown fields of known types."""
    types = dictionary.select(F.col("obj_type").alias("object_type")).distinct()
    fields = dictionary.select(F.col("obj_type").alias("object_type"), "field").distinct()
    w002 = lookup_join(objects, types, ["object_type"], "left_anti")
    w003 = lookup_join(lookup_join(values, fields, ["object_type", "field"], "left_anti"), types, ["object_type"], "left_semi")
    return _finding(w002, F.lit("W002"), F.lit(None), "warning", model).unionByName(_finding(w003, F.lit("W003"), F.col("field"), "warning", model))


def compare_findings(found: DataFrame, expected: DataFrame, model: Sequence[str] = ()) -> DataFrame:
    """All severities as one bag against the expected bag."""
    return multiset_diff(found, expected, [*model, *FINDING])


def describe(dictionary: DataFrame, types: DataFrame) -> DataFrame:
    """Types present, each with its required fields and its fields with union types, in order."""
    held = lookup_join(dictionary, types.select("obj_type").distinct(), ["obj_type"], "left_semi")
    kind = F.array_join(F.array_distinct(F.transform("branches", lambda b: b["type"])), "|")
    return held.groupBy("obj_type").agg(
        F.count(F.lit(1)).alias("fields"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "field", kind).alias("t")))), lambda x: x["t"]), ",").alias("described"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("required"), F.struct("pos", "field")))), lambda x: x["field"]), ",").alias("required"),
    )


def diff_dictionaries(before: DataFrame, after: DataFrame) -> DataFrame:
    """Types added and removed, and fields added and removed within types both have.

    A rename is never inferred: it is one removal and one addition.
    """
    bt, at = before.select("obj_type").distinct(), after.select("obj_type").distinct()
    shared = bt.join(at, "obj_type", "left_semi")
    bf, af = before.select("obj_type", "field").distinct(), after.select("obj_type", "field").distinct()

    def types(df: DataFrame, change: str) -> DataFrame:
        return df.select("obj_type", F.lit(None).cast("string").alias("field"), F.lit(change).alias("change"))

    def fields(df: DataFrame, change: str) -> DataFrame:
        return df.join(shared, "obj_type", "left_semi").select("obj_type", "field", F.lit(change).alias("change"))

    return (
        types(at.join(bt, "obj_type", "left_anti"), "type added")
        .unionByName(types(bt.join(at, "obj_type", "left_anti"), "type removed"))
        .unionByName(fields(af.join(bf, ["obj_type", "field"], "left_anti"), "field added"))
        .unionByName(fields(bf.join(af, ["obj_type", "field"], "left_anti"), "field removed"))
    )


def clean_renames(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Pairs of a rename table that really rename: no comments, headers, numbers, blanks or copies."""
    a, b = F.trim(F.col(old)), F.trim(F.col(new))
    keep = (a != "") & (b != "") & ~a.rlike("^(!|old|Old)") & ~a.rlike("^[0-9.]+$") & (a != b)
    return rows.withColumns({old: a, new: b}).where(F.coalesce(keep, F.lit(False)))
