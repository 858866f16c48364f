"""The two checks against outside figures: monthly means of hourly files, and rings in the world."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators import reserved, rings


def monthly_check(
    hourly: DataFrame, station: Sequence[str], month: Column, column: str, missing: Sequence[float], expected: DataFrame
) -> DataFrame:
    """Mask what was not measured, average by month, compare with the published means."""
    masked = hourly.withColumn(column, reserved.mask_reserved(F.col(column), missing))
    means = reserved.monthly_means(masked, station, month, F.col(column))
    return reserved.check_means(means, expected, station)


def ring_check(resolved: DataFrame, rules: DataFrame, zones: DataFrame, reported: DataFrame, unattempted: DataFrame) -> DataFrame:
    """Bring rings to the world, compare them with the report, account for the rest, sum up."""
    world = rings.to_world(resolved, rules, zones)
    compared = rings.compare_rings(world, reported)
    return rings.ring_summary(compared, rings.omissions(world, reported, unattempted))
