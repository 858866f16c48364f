"""Quality rules of a record table. Each gives findings (rule, key, message)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.graphs import cycles
from concord.operators.skew import spread_join


def _found(df: DataFrame, rule: str, key: str | Column, message: str | Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )


def unique(df: DataFrame, key: str) -> DataFrame:
    """Keys that are absent, and keys met more than once (one finding per key)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    missing = F.col(key).isNull() | (F.col(key).cast("string") == "")
    return _found(
        counts.where(missing | (F.col("_n") > 1)), "unique", key, F.when(missing, "no key").otherwise(F.concat(F.lit("met "), "_n", F.lit(" times")))
    )


def in_set(df: DataFrame, key: str, column: str, allowed: Sequence[str]) -> DataFrame:
    bad = ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return _found(df.where(bad), "domain", key, F.concat(F.lit(f"{column} is "), F.coalesce(F.col(column).cast("string"), F.lit("absent"))))


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")


def required_if(df: DataFrame, key: str, column: str, condition: Column) -> DataFrame:
    return _found(df.where(condition & _blank(column)), "required", key, f"{column} is required")


def forbidden_if(df: DataFrame, key: str, column: str, condition: Column) -> DataFrame:
    return _found(df.where(condition & ~_blank(column)), "forbidden", key, f"{column} is forbidden")


def exactly_one(df: DataFrame, key: str, flags: Sequence[Column], or_none: bool = False) -> DataFrame:
    """Records on which not exactly one flag holds (``or_none``: more than one)."""
    n = sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))
    return _found(df.where(n > 1 if or_none else n != 1), "exactly-one", key, F.concat(n.cast("string"), F.lit(" hold")))


def matches(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return _found(df.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False))), "shape", key, f"{column} has another shape")


def foreign_key(df: DataFrame, key: str, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """References, scalar or array-valued, that name nothing."""
    is_array = dict(df.dtypes)[column].startswith("array")
    named = df.select(F.col(key).alias("_key"), (F.explode(column) if is_array else F.col(column)).alias("_ref")).where("_ref IS NOT NULL")
    known = ref.select(F.col(ref_column).alias("_ref")).distinct()
    dangling = spread_join(named, known, ["_ref"], "left_anti")
    return _found(dangling, "foreign-key", "_key", F.concat(F.lit(f"{column} names "), F.col("_ref").cast("string")))


def must_not_match(df: DataFrame, key: str, column: str, pattern: str, exempt: Sequence[str] = ()) -> DataFrame:
    held = df.where(F.col(column).rlike(pattern))
    if exempt:
        held = held.where(~F.col(key).cast("string").isin(*exempt))
    return _found(held, "must-not-match", key, f"{column} holds what it must not")


def agree(df: DataFrame, group: str, column: str) -> DataFrame:
    """Groups that state more than one value: one finding per group and value."""
    stated = df.where(F.col(column).isNotNull()).select(group, column).distinct()
    many = stated.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(group)
    conflicting = spread_join(stated, many, [group], "left_semi")
    return _found(conflicting, "agree", group, F.concat(F.lit(f"states {column} "), F.col(column).cast("string")))


def covers(df: DataFrame, column: str, expected: DataFrame, expected_column: str) -> DataFrame:
    """Expected members that are missing, and members nobody expected."""
    have = df.select(F.col(column).alias("_m")).distinct()
    want = expected.select(F.col(expected_column).alias("_m")).distinct()
    return _found(want.join(have, "_m", "left_anti"), "covers", "_m", "missing").unionByName(
        _found(have.join(want, "_m", "left_anti"), "covers", "_m", "unexpected")
    )


def cycle_findings(edges: DataFrame) -> DataFrame:
    return _found(cycles(edges), "acyclic", "node", "lies on a cycle")


def summarise(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"))
