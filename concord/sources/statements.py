"""Statement text: ``Type, field, field;`` with ``!`` comments, one row per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.arrays import running_sum
from concord.functions.binding import let

# Fixed pattern: a comment, up to the end of its line.
COMMENT = "![^\\n\\r]*"


def _feeds(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def _fields(found: DataFrame, ids: list[str]) -> DataFrame:
    """Rows (ids, seq, terminated, _part, _feeds: line feeds before the part) as one row per field."""
    lead = F.regexp_extract("_part", "^\\s*", 0)
    rows = found.where(F.col("_part").rlike("\\S")).select(
        *ids, "seq", (F.col("_feeds") + _feeds(lead) + 1).alias("line"), "terminated", F.split("_part", ",").alias("_cells")
    )
    tidy = lambda cell: F.trim(F.regexp_replace(cell, "\\s*[\\r\\n]+\\s*", " "))
    return rows.select(
        *ids, "seq", "line", "terminated", tidy(F.get("_cells", F.lit(0))).alias("obj_type"), F.posexplode_outer(F.slice("_cells", F.lit(2), F.size("_cells"))).alias("pos", "_cell")
    ).select(*ids, "seq", "line", "terminated", "obj_type", "pos", tidy(F.col("_cell")).alias("raw"))


def _numbered(parts: Column) -> Column:
    """Each part with the line feeds of the parts before it."""
    return let(
        parts, lambda ps: let(running_sum(F.transform(ps, _feeds)), lambda before: F.transform(ps, lambda p, i: F.struct(p.alias("part"), F.get(before, i).alias("feeds"))))
    )


def statements(files: DataFrame, ids: list[str], text: str = "content", at: str | None = None) -> DataFrame:
    """One row per field: statement number, line it starts on, type, position, value.

    A comment runs from ``!`` to the end of its line. A line break inside a value is whitespace:
    the parts join with one space. Position 0 is the first field after the type. Text after the
    last semicolon is a statement with ``terminated`` false.

    Without ``at`` a row is a file; nothing is shuffled. With it a row is a piece of a file, ``at`` its place, and a file of
    any length may be cut anywhere. Each piece tells whether it leaves a comment open, its semicolons and its line feeds;
    running values over those few numbers give every piece the state it begins in. Statements inside a piece are read
    there; the ends of pieces meet by statement. Only a statement has to fit in a task.
    """
    if at is None:
        bare = files.select(*ids, F.regexp_replace(F.col(text), COMMENT, "").alias("_bare"))
        parts = bare.select(*ids, F.posexplode_outer(_numbered(F.split("_bare", ";"))).alias("_i", "_p"), F.regexp_count("_bare", F.lit(";")).alias("_marks"))
        rows = parts.where("_p IS NOT NULL")
        return _fields(rows.select(*ids, (F.col("_i") + 1).alias("seq"), (F.col("_i") < F.col("_marks")).alias("terminated"), F.col("_p.part").alias("_part"), F.col("_p.feeds").alias("_feeds")), ids)
    pieces = files.select(*ids, F.col(at).alias("_at"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    breaks = F.translate("_t", "\r", "\n")
    told = pieces.select(
        *ids, "_at",
        F.when(F.contains(breaks, F.lit("\n")), F.col("_at")).alias("_broke"),
        F.when(F.contains(F.substring_index(breaks, "\n", -1), F.lit("!")), F.col("_at")).alias("_noted"),
    )
    before = Window.partitionBy(*ids).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # A comment is open where the last mark came no earlier than the last line break.
    noted, broke = F.max("_noted").over(before), F.max("_broke").over(before)
    opened = told.select(*ids, "_at", F.coalesce(noted >= broke, noted.isNotNull()).alias("_in"))
    text_now = F.regexp_replace(F.concat(F.when(F.col("_in"), "!").otherwise(""), F.col("_t")), COMMENT, "")
    bare = pieces.join(opened, [*ids, "_at"]).select(*ids, "_at", text_now.alias("_bare"))
    sums = bare.select(*ids, "_at", F.regexp_count("_bare", F.lit(";")).cast("long").alias("_semis"), _feeds(F.col("_bare")).alias("_lf"))
    whole = Window.partitionBy(*ids)
    begun = sums.select(
        *ids, "_at", F.coalesce(F.sum("_semis").over(before), F.lit(0)).alias("_seq"), F.coalesce(F.sum("_lf").over(before), F.lit(0)).alias("_above"), F.sum("_semis").over(whole).alias("_all")
    )
    rows = bare.join(begun, [*ids, "_at"]).select(*ids, "_at", "_seq", "_above", "_all", F.posexplode(_numbered(F.split("_bare", ";"))).alias("_i", "_p"), F.regexp_count("_bare", F.lit(";")).alias("_marks"))
    placed = rows.select(
        *ids, "_at", (F.col("_seq") + F.col("_i") + 1).alias("seq"), "_all", F.col("_p.part").alias("_part"), (F.col("_above") + F.col("_p.feeds")).alias("_feeds"),
        ((F.col("_i") > 0) & (F.col("_i") < F.col("_marks"))).alias("_whole"),
    )
    terminated = (F.col("seq") <= F.col("_all")).alias("terminated")
    inner = placed.where("_whole").select(*ids, "seq", terminated, "_part", "_feeds")
    ends = placed.where("NOT _whole").groupBy(*ids, "seq", "_all").agg(F.array_sort(F.collect_list(F.struct("_at", "_part"))).alias("_ends"), F.min("_feeds").alias("_feeds"))
    joined = ends.select(*ids, "seq", terminated, F.array_join("_ends._part", "").alias("_part"), "_feeds")
    found = _fields(inner.unionByName(joined), ids)
    return found.withColumn("seq", F.col("seq").cast("int"))
