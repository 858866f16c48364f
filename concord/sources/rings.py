"""Ragged ring files and mixed-shape reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.binding import let

# Fixed values of the report: the two row kinds that carry rings, and the field that holds the
# number of vertices (the kind is field 0).
ROW_KINDS = ("HeatTransfer Surface", "Shading Surface")
SIDES_FIELD = 26

# Stands for a comma outside quotes while a line is cut; no text file holds it.
CUT = "\x1f"


def vertices_of(numbers: Column) -> Column:
    """Numbers three by three as vertices."""
    vertex = lambda ns, i: F.struct(F.get(ns, i * 3).alias("x"), F.get(ns, i * 3 + 1).alias("y"), F.get(ns, i * 3 + 2).alias("z"))
    return let(
        numbers,
        lambda ns: F.when(F.size(ns) < 3, F.array().cast("array<struct<x:double,y:double,z:double>>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.floor(F.size(ns) / 3).cast("int") - 1), lambda i: vertex(ns, i))
        ),
    )


def _unquoted(cell: Column) -> Column:
    return F.when(
        cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1),
        F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"')),
    ).otherwise(cell)


def _cells(line: str) -> Column:
    """The cells of a line. Quotes part it into stretches outside and inside of quotes by turns; only commas outside cut."""
    turns = F.transform(F.split(line, '"', -1), lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(","), F.lit(CUT))).otherwise(part))
    plain = F.split(line, ",", -1)
    return F.when(F.contains(F.col(line), F.lit('"')), F.transform(F.split(F.array_join(turns, '"'), CUT, -1), _unquoted)).otherwise(plain)


def ring_scan(lines: DataFrame, keys: list[str] = [], line: str = "value") -> DataFrame:  # noqa: B006
    """Ring rows: kind, name, surface_class, base_surface, then a count and three numbers each; ``reject`` says what is wrong.

    Refused are a quote that is not closed, a count that is no whole number from 0, numbers fewer or more than three for
    each vertex, and what is no number. Lines are read in time linear in their length.
    """
    body = lines.where(~F.col(line).startswith("#") & ~F.col(line).startswith("kind,") & (F.trim(line) != ""))
    quotes = F.length(line) - F.length(F.replace(F.col(line), F.lit('"'), F.lit("")))
    rows = body.select(*keys, _cells(line).alias("_c"), (quotes % 2 == 1).alias("_open")).withColumn("_n", F.get("_c", F.lit(4)).try_cast("int"))
    rows = rows.withColumn("_numbers", F.transform(F.slice("_c", F.lit(6), F.greatest(F.size("_c") - 5, F.lit(0))), lambda v: v.try_cast("double")))
    reject = (
        F.when(F.col("_open"), "quote not closed")
        .when(F.col("_n").isNull() | (F.col("_n") < 0), "no count")
        .when(F.size("_numbers") != 3 * F.col("_n"), F.concat(F.col("_n").cast("string"), F.lit(" vertices stated, "), F.size("_numbers").cast("string"), F.lit(" numbers")))
        .when(F.exists("_numbers", lambda v: v.isNull()), "no number")
    )
    return rows.select(
        *keys,
        F.get("_c", F.lit(0)).alias("kind"),
        F.get("_c", F.lit(1)).alias("name"),
        F.get("_c", F.lit(2)).alias("surface_class"),
        F.get("_c", F.lit(3)).alias("base_surface"),
        vertices_of(F.col("_numbers")).alias("vertices"),
        reject.alias("reject"),
    )


def parse_rings(lines: DataFrame, keys: list[str] = [], line: str = "value") -> DataFrame:  # noqa: B006
    """The rings of ``ring_scan``."""
    return ring_scan(lines, keys, line).where("reject IS NULL").drop("reject")


def ring_rejects(lines: DataFrame, keys: list[str] = [], line: str = "value") -> DataFrame:  # noqa: B006
    """What ``ring_scan`` refuses: keys, name and reason."""
    return ring_scan(lines, keys, line).where("reject IS NOT NULL").select(*keys, "name", "reject")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """Rings of the files of a folder or glob, by file."""
    return parse_rings(_lines(spark, path), ["file"])


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """The ``# key: value`` header lines, by file."""
    lines = _lines(spark, path).where(F.col("value").startswith("#"))
    text = F.trim(F.regexp_replace("value", "^#", ""))
    return lines.select(
        "file",
        F.trim(F.substring_index(text, ":", 1)).alias("key"),
        F.trim(F.regexp_extract(text, "^[^:]*:(.*)$", 1)).alias("value"),
    )


def ring_lines(rings: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Rings as text lines with two decimals, the form ``parse_rings`` reads."""
    def quoted(c: str) -> Column:
        cell = F.coalesce(F.col(c), F.lit(""))
        return F.when(cell.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)

    def fixed(axis: Column) -> Column:
        return F.round(axis, 2).cast("decimal(20,2)").cast("string")

    flat = F.flatten(F.transform("vertices", lambda v: F.array(fixed(v["x"]), fixed(v["y"]), fixed(v["z"]))))
    return rings.select(
        *keys,
        F.concat_ws(
            ",", quoted("kind"), quoted("name"), quoted("surface_class"), quoted("base_surface"),
            F.size("vertices").cast("string"), flat,
        ).alias("value"),
    )


def report_rows(lines: DataFrame, keys: list[str], line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Ring rows of a mixed-shape report, and the rows whose count disagrees with their cells."""
    cells = F.transform(F.split(line, ",", -1), lambda c: F.trim(c))
    rows = (
        lines.select(*keys, F.substring_index(line, ",", 1).alias("kind"), cells.alias("_c"))
        .where(F.col("kind").isin(*ROW_KINDS))
        .withColumn("sides", F.get("_c", F.lit(SIDES_FIELD)).try_cast("int"))
        .withColumn("_flat", F.slice("_c", F.lit(SIDES_FIELD + 2), F.greatest(F.col("sides") * 3, F.lit(0))))
        .withColumn("_numbers", F.transform("_flat", lambda v: v.try_cast("double")))
    )
    good = F.coalesce((F.size("_flat") == F.col("sides") * 3) & F.forall("_numbers", lambda v: v.isNotNull()), F.lit(False))
    kept = rows.where(good).select(
        *keys,
        "kind",
        F.get("_c", F.lit(1)).alias("name"),
        F.get("_c", F.lit(2)).alias("surface_class"),
        F.get("_c", F.lit(3)).alias("base_surface"),
        vertices_of(F.col("_numbers")).alias("vertices"),
    )
    rejects = rows.where(~good).select(
        *keys, F.get("_c", F.lit(1)).alias("name"), "sides", F.floor(F.size("_flat") / 3).cast("int").alias("carried")
    )
    return kept, rejects
