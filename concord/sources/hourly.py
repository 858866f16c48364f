"""Hourly files: eight header lines, then positional columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value.
HEADER_LINES = 8

# Numeric columns of an hourly row by position.
POSITIONS = {
    6: "dry_bulb_temperature", 7: "dew_point_temperature", 8: "relative_humidity",
    9: "atmospheric_station_pressure", 10: "extraterrestrial_horizontal_radiation",
    11: "extraterrestrial_direct_normal_radiation", 12: "horizontal_infrared_radiation_intensity_from_sky",
    13: "global_horizontal_radiation", 14: "direct_normal_radiation", 15: "diffuse_horizontal_radiation",
    16: "global_horizontal_illuminance", 17: "direct_normal_illuminance", 18: "diffuse_horizontal_illuminance",
    19: "zenith_luminance", 20: "wind_direction", 21: "wind_speed", 22: "total_sky_cover",
    23: "opaque_sky_cover", 24: "visibility", 25: "ceiling_height", 26: "present_weather_observation",
    28: "precipitable_water", 29: "aerosol_optical_depth", 30: "snow_depth", 31: "days_since_last_snowfall",
    32: "albedo", 33: "liquid_precipitation_depth", 34: "liquid_precipitation_quantity",
}


def hourly_rows(files: DataFrame, keys: list[str], positions: Mapping[int, tuple[str, str]], text: str = "content") -> DataFrame:
    """One row per data line: 0-based row number and the named positional columns.

    Any line ending is accepted and blank lines are skipped. ``positions`` maps a position to
    (column, Spark type).
    """
    even = F.regexp_replace(F.col(text), "\\r\\n?", "\n")
    lines = F.filter(F.slice(F.split(even, "\n"), HEADER_LINES + 1, 2**31 - 10), lambda line: F.trim(line) != "")
    rows = files.select(*keys, F.posexplode(lines).alias("row", "_line")).withColumn("_c", F.split("_line", ","))
    return rows.select(
        *keys, "row", *[F.trim(F.get("_c", F.lit(p))).try_cast(kind).alias(name) for p, (name, kind) in positions.items()]
    )


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """Hourly files of a folder or glob, with station (file path), time and numeric columns."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("station"), F.col("value").alias("content"))
    time = {0: ("year", "int"), 1: ("month", "int"), 2: ("day", "int"), 3: ("hour", "int"), 4: ("minute", "int")}
    return hourly_rows(files, ["station"], {**time, **{p: (n, "double") for p, n in POSITIONS.items()}})
