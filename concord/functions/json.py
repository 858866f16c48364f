"""JSON types and pointers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_type(value: Column) -> Column:
    """The JSON type of a variant: null, boolean, number, string, array or object.

    Text that looks like a number is a string and a boolean is never a number.
    """
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (schema == "VOID"), "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "STRING", "string")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def pointer_token(key: Column) -> Column:
    """RFC 6901 escaping: the tilde first, then the slash."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def ancestors(pointer: Column) -> Column:
    """Every proper ancestor pointer, the root (empty text) included; empty for the root."""
    tokens = F.split(pointer, "/")
    return F.when(
        F.size(tokens) > 1,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda n: F.array_join(F.slice(tokens, F.lit(1), n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def pointer_pattern(pointer: Column) -> Column:
    """The pointer without what belongs to one file: second token `*`, all-digit tokens `#`."""
    tokens = F.slice(F.split(pointer, "/"), 2, 2**31 - 2)
    erased = F.transform(
        tokens,
        lambda token, at: F.when(at == 1, F.lit("*")).when(token.rlike(r"^\d+$"), F.lit("#")).otherwise(token),
    )
    return F.when(pointer == "", F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(erased, "/")))


def preview(value: Column, limit: int) -> Column:
    """A value cut to ``limit`` characters, with dots when something was cut."""
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit("..."))).otherwise(value)
