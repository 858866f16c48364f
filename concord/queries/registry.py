"""Registry of runnable queries: each runs an operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

#: Rows of a partition that a table is dealt out in.
SPREAD_ROWS = 100_000

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query, with the SQL that must give the same rows (none: rows only)."""

    def keep(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table. ``spread`` is for work that costs far more than moving its rows: a table
    that reads as fewer partitions than there are cores (one small file), or than its rows need at
    ``SPREAD_ROWS`` each (a compact file of few row groups), is dealt out. Rows are counted from the footers."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not spread:
        return df
    parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
