"""Where two texts differ, as regions with offsets, lines and bounded windows.

Positions are 0-based characters. Every step works inside one row, chunk by chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.binding import let

# Width of a shown window; agreeing characters that close a region.
WINDOW = 80
RESYNC = 8


def line_col(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column of a 0-based offset. Only a line feed ends a line."""
    before = F.left(text, F.greatest(F.lit(0), F.least(offset, F.length(text))))
    line = F.regexp_count(before, F.lit("\n")) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    return line, column


def drift_window(span: Column, limit: int = WINDOW) -> Column:
    """A bounded view of one side of a region, with how much was left out."""
    return (
        F.when(F.length(span) == 0, F.lit("nothing"))
        .when(F.length(span) > limit,
              F.concat(F.left(span, F.lit(limit)), F.lit(" (+"), (F.length(span) - limit).cast("string"), F.lit(" more)")))
        .otherwise(span)
    )


# Characters of a chunk. Only chunks that differ are taken apart.
CHUNK = 256


def _chunks(text: Column) -> Column:
    """A text in chunks, cut in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _chars(text: Column) -> Column:
    """The characters of a chunk. (Splitting an empty text would give one empty character.)"""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _unlike(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _common(left: Column, right: Column) -> Column:
    """How many characters two texts share from their begin: equal chunks, and what the first unlike chunks share."""

    def inside(pair: Column, at: Column) -> Column:
        first = F.array_position(F.zip_with(_chars(pair["l"]), _chars(pair["r"]), _unlike), True)
        return at * CHUNK + first - 1

    def first_unlike(pairs: Column) -> Column:
        return let(
            (F.array_position(F.transform(pairs, lambda p: _unlike(p["l"], p["r"])), True) - 1).cast("int"),
            lambda at: F.when(at < 0, F.lit(None).cast("long")).otherwise(let(F.get(pairs, at), lambda p: inside(p, at))),
        )

    whole = F.least(F.length(left), F.length(right))
    return F.coalesce(let(F.arrays_zip(_chunks(left).alias("l"), _chunks(right).alias("r")), first_unlike), whole).cast("int")


def _spots(left: Column, right: Column) -> Column:
    """Positions at which two texts of one length differ, in order."""

    def opened(p: Column, at: Column) -> Column:
        flags = F.zip_with(_chars(p["l"]), _chars(p["r"]), _unlike)
        return F.filter(F.transform(flags, lambda f, i: F.when(f, at * CHUNK + i)), lambda i: i.isNotNull())

    pairs = F.arrays_zip(_chunks(left).alias("l"), _chunks(right).alias("r"))
    numbered = F.transform(pairs, lambda p, at: F.struct(p["l"].alias("l"), p["r"].alias("r"), at.alias("at")))
    return F.flatten(F.transform(F.filter(numbered, lambda p: _unlike(p["l"], p["r"])), lambda p: opened(p, p["at"])))


def text_drift(pairs: DataFrame, keys: list[str], left: str, right: str, left_spans: str | None = None, right_spans: str | None = None) -> DataFrame:
    """Differing regions of two texts: offsets in both, line and column, both sides' text.

    Common prefix and suffix go first. Middles of one length are walked together, and differing
    characters closer than ``RESYNC`` agreeing ones form one region; middles of unlike length are
    one region. ``*_spans`` name columns of merged excluded spans (arrays of start, end): their
    characters are not compared, and offsets still refer to the whole text.

    Texts are compared chunk by chunk in time linear in their length; a pair of any length Spark holds in a row is
    compared. A null text against one that is none is a region of its own at 0, with null for the text that is not there.
    """
    df = pairs.select(
        *keys,
        F.col(left).alias("_lt"),
        F.col(right).alias("_rt"),
        *([F.col(left_spans).alias("_ls")] if left_spans else []),
        *([F.col(right_spans).alias("_rs")] if right_spans else []),
    )
    lone = F.col("_lt").isNull() != F.col("_rt").isNull()
    df = df.withColumns(
        {"_lone": lone, "_lk": F.coalesce(_kept("_lt", "_ls" if left_spans else None), F.lit("")), "_rk": F.coalesce(_kept("_rt", "_rs" if right_spans else None), F.lit(""))}
    )
    df = df.where(F.col("_lone") | (F.col("_lk") != F.col("_rk")))
    df = df.withColumn("_p", _common(F.col("_lk"), F.col("_rk")))
    room = F.least(F.length("_lk"), F.length("_rk")) - F.col("_p")
    df = df.withColumn("_x", F.least(_common(F.reverse("_lk"), F.reverse("_rk")), room))
    df = df.withColumns({"_ml": F.length("_lk") - F.col("_x") - F.col("_p"), "_mr": F.length("_rk") - F.col("_x") - F.col("_p")})
    # Differing positions of equal middles.
    middle = lambda side, n: F.substring(side, F.col("_p") + 1, F.col(n))
    walked = (F.col("_ml") == F.col("_mr")) & ~F.col("_lone")
    df = df.withColumn("_d", F.when(walked, _spots(middle("_lk", "_ml"), middle("_rk", "_mr"))))
    d = F.col("_d")
    starts = let(d, lambda d: F.filter(d, lambda p, i: (i == 0) | (p - F.get(d, i - 1) > RESYNC)))
    ends = let(d, lambda d: F.filter(d, lambda p, i: (i == F.size(d) - 1) | (F.get(d, i + 1) - p > RESYNC)))
    df = df.withColumns({"_starts": starts, "_ends": ends})
    regions = F.when(
        d.isNotNull(),
        F.zip_with(
            "_starts",
            "_ends",
            lambda s, e: F.struct((F.col("_p") + s).alias("at"), (e - s + 1).alias("nl"), (e - s + 1).alias("nr")),
        ),
    ).otherwise(F.array(F.struct(F.col("_p").alias("at"), F.col("_ml").alias("nl"), F.col("_mr").alias("nr"))))
    df = df.withColumn("_r", F.explode_outer(regions)).where("_r IS NOT NULL")
    at = F.col("_r.at")
    df = df.withColumns(
        {
            "offset": _original(at, "_lt", "_ls" if left_spans else None),
            "right_offset": _original(at, "_rt", "_rs" if right_spans else None),
            "left_text": F.when(F.col("_lt").isNotNull(), F.substring("_lk", at + 1, F.col("_r.nl"))),
            "right_text": F.when(F.col("_rt").isNotNull(), F.substring("_rk", at + 1, F.col("_r.nr"))),
        }
    )
    line, column = line_col(F.coalesce("_lt", F.lit("")), F.col("offset"))
    return df.select(*keys, "offset", line.alias("line"), column.alias("column"), "right_offset", "left_text", "right_text")


def _kept(text: str, spans: str | None) -> Column:
    """The text outside its excluded spans."""
    if spans is None:
        return F.col(text)
    s = F.col(spans)
    pieces = F.transform(
        s,
        lambda span, i: F.substring(
            F.col(text),
            F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"]) + 1,
            span["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"]),
        ),
    )
    last = F.substring(F.col(text), F.element_at(s, -1)["end"] + 1, F.length(text))
    return F.when(F.coalesce(F.size(s), F.lit(0)) < 1, F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), last))


def _original(at: Column, text: str, spans: str | None) -> Column:
    """The offset in the whole text of the surviving character ``at``."""
    if spans is None:
        return F.least(at, F.coalesce(F.length(text), F.lit(0)))
    # Each span that starts at or before the place reached so far moves the place by its length.
    moved = F.aggregate(
        F.col(spans),
        at.cast("int"),
        lambda place, span: F.when(span["start"] <= place, place + (span["end"] - span["start"])).otherwise(place).cast("int"),
    )
    return F.least(F.coalesce(moved, at), F.coalesce(F.length(text), F.lit(0)))
