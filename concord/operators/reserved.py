"""Aggregates that honour reserved values.

A reserved table is a short fixed list (position, field, value, kind): kind ``missing`` means the
measurement was not made, kind ``observation`` is an unusual value that was.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = 12


def mask_reserved(value: Column, missing: Sequence[float]) -> Column:
    """Null where the value says that nothing was measured. Observations are not in ``missing``."""
    return value if not missing else F.when(~F.coalesce(value.isin(*missing), F.lit(False)), value)


def mask_table(df: DataFrame, columns: Mapping[str, Sequence[float]]) -> DataFrame:
    return df.withColumns({c: mask_reserved(F.col(c), missing) for c, missing in columns.items()})


def monthly_means(df: DataFrame, station: Sequence[str], month: Column, value: Column) -> DataFrame:
    """Mean over the hours that are present, for all twelve months; none present, no value.

    The divisor is the number of present values, not the hours of the calendar.
    """
    means = df.groupBy(*station, month.cast("int").alias("month")).agg(F.avg(value).alias("mean"), F.count(value).alias("present"))
    stations = df.select(*station).distinct()
    spine = stations.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(MONTHS))))
    return spine.join(means, [*station, "month"], "left").withColumn("present", F.coalesce("present", F.lit(0)))


def coverage(expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each expectation as ``covered`` or ``uncovered`` with its reason.

    A covered one that is not twelve numbers with a tolerance stops the run.
    """
    covered = F.coalesce("covered", F.lit(True))
    sound = (F.size("monthly") == MONTHS) & F.forall("monthly", lambda m: m.isNotNull()) & F.col("tolerance").isNotNull()
    named = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    state = (
        F.when(~covered, "uncovered")
        .when(F.coalesce(sound, F.lit(False)), "covered")
        .otherwise(F.raise_error(F.concat(named, F.lit(": the expectation is not twelve numbers with a tolerance"))))
    )
    return expected.withColumn("state", state).withColumn(
        "reason", F.when(F.col("state") == "uncovered", F.coalesce("reason", F.lit("the summary has no such section")))
    )


def check_means(means: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per covered month: actual, expected, passed. No actual value is a failure."""
    wanted = (
        coverage(expected, keys)
        .where("state = 'covered'")
        .select(*keys, "tolerance", F.posexplode("monthly").alias("_at", "expected"))
        .withColumn("month", F.col("_at") + 1)
    )
    actual = means.select(*keys, "month", F.col("mean").alias("actual"))
    known = F.col("actual").isNotNull() & ~F.isnan("actual")
    return (
        wanted.join(actual, [*keys, "month"], "left")
        .select(*keys, "month", "actual", "expected", "tolerance")
        .withColumn("passed", F.coalesce(known & (F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance")), F.lit(False)))
    )


def audit_reserved(raw: DataFrame, read: DataFrame, rows: Sequence[str], table: Sequence[tuple[int, float, str]]) -> DataFrame:
    """What a reader did with each reserved value that the file holds.

    ``raw`` and ``read`` are rows (rows..., row, position, value). Result per (position, value,
    kind): rows at the value, rows misread, first misread row (1-based). A missing value read as a
    number is misread, and so is an observation that was blanked. Values met nowhere have no row.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.lit(float(v)).alias("value"), F.lit(k).alias("kind")) for p, v, k in table]))
    values = raw.sparkSession.range(1).select(entries.alias("e")).select("e.*")
    held = raw.join(F.broadcast(values), ["position", "value"])  # the table is a literal list
    seen = held.join(read.select(*rows, "row", "position", F.col("value").alias("_read")), [*rows, "row", "position"], "left")
    blank = F.col("_read").isNull() | F.isnan("_read")
    wrong = F.when(F.col("kind") == "missing", ~blank).otherwise(blank)
    return seen.groupBy("position", "value", "kind").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(wrong.cast("long")).alias("misread"),
        (F.min(F.when(wrong, F.col("row"))) + 1).alias("first_misread"),
    )


def unpaired(files: DataFrame, name: str, data_suffix: str, summary_suffix: str) -> DataFrame:
    """Data files with no summary beside them."""
    stem = F.regexp_replace(name, f"({_literal(data_suffix)}|{_literal(summary_suffix)})$", "")
    data = files.where(F.col(name).endswith(data_suffix)).withColumn("_stem", stem)
    summaries = files.where(F.col(name).endswith(summary_suffix)).select(stem.alias("_stem")).distinct()
    return data.join(summaries, "_stem", "left_anti").drop("_stem")


def exactly_one(files: DataFrame) -> DataFrame:
    """The only row, or a failed run. At most two rows are looked at."""
    n = F.count(F.lit(1))
    first = files.limit(2).agg(*[F.min(c).alias(c) for c in files.columns], n.alias("_n"))
    return first.select(
        *[F.when(F.col("_n") == 1, F.col(c)).otherwise(F.raise_error(F.lit("expected exactly one file without a summary"))).alias(c) for c in files.columns]
    )


def _literal(text: str) -> str:
    return text.replace(".", "\\.")
