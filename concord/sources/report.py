"""Report sink: findings in long form, totals and groups as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_findings(findings: DataFrame, path: str, by: str = "kind") -> None:
    """Findings as parquet, one folder per kind."""
    findings.write.mode("errorifexists").partitionBy(by).parquet(path)


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Each part of a report (totals, groups, families) as JSON lines in its own folder."""
    for name, df in parts.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")
