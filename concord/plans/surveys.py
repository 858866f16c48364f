"""Composed reports: statements and strangers of a corpus of files, and the standing of a fleet of consumers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import fleet, scan
from concord.operators.skew import lookup_join, spread_join


@dataclass(frozen=True)
class ScanReport:
    findings: DataFrame
    unread: DataFrame
    summary: DataFrame


def scan_run(
    files: DataFrame, project: str, path: str, text: str, roster: DataFrame, failed: DataFrame, declared: DataFrame,
    release: tuple[int, int, int], count: int | None = None, accounted: Sequence[str] = (), ignored_lines: Sequence[str] = (),
) -> ScanReport:
    """Everything that a corpus says of a release and should not, or should say and does not.

    ``roster`` is (project, lags): projects that lag skip the statement check, not the search for strangers. ``failed`` is
    (project, reason) of what could not be read; a listed project without any file is unread too. Unread projects have no
    findings. ``declared`` is (project, path, pattern, occurrences, form), see ``check_statements``.

    Findings are (project, path, finding, line, found, expected, shown): missing, stale, stranger, and no file for a
    declaration whose path names none that exists.
    """
    keys = [project, path]
    listed = roster.select(project, "lags").distinct()
    empty = spread_join(listed.select(project), files.select(project).distinct(), [project], "left_anti")
    unread = failed.select(project, "reason").join(listed.select(project), project, "left_semi").unionByName(
        empty.join(failed.select(project), project, "left_anti").withColumn("reason", F.lit("no files are listed"))
    )
    readable = listed.join(unread.select(project).distinct(), project, "left_anti")
    held = lookup_join(files, readable.select(project), [project], "left_semi")
    stated = lookup_join(declared, readable.select(project), [project], "left_semi")
    current = scan.without_lagging(stated, listed.where("lags"), project)
    checked = scan.check_statements(held, keys, text, current, release, count)
    loose = scan.stranger_occurrences(
        held, keys, path, text, scan.spellings(*release), stated.select(*keys, "pattern"), accounted, ignored_lines
    )
    absent = scan.missing_declared(stated.select(*keys).distinct(), held, keys)

    def row(df: DataFrame, finding: str) -> DataFrame:
        have = df.columns
        rest = [F.col(c) if c in have else F.lit(None).cast("long" if c == "line" else "string").alias(c) for c in ("line", "found", "expected", "shown")]
        return df.select(*keys, (F.col("finding") if "finding" in have else F.lit(finding)).alias("finding"), *rest)

    findings = row(checked, "").unionByName(row(loose, "stranger")).unionByName(row(absent, "no file"))
    summary = findings.groupBy(project, "finding").agg(F.count(F.lit(1)).alias("occurrences"))
    return ScanReport(findings, unread, summary)


@dataclass(frozen=True)
class FleetReport:
    current: DataFrame
    standings: DataFrame
    delivered: DataFrame
    findings: DataFrame


def fleet_run(
    observations: DataFrame, releases: DataFrame, declarations: DataFrame, governed: Mapping[str, Sequence[str]],
    unreachable: DataFrame, found: DataFrame, roster: DataFrame, out_of_scope: Sequence[str] = (),
) -> FleetReport:
    """Where every consumer of a library stands, and what must be explained.

    ``releases`` is (library, version); the newest by number is current. ``unreachable`` is (repository, reason) of
    what could not be read: such consumers have no standing. ``declarations`` are as in ``disagreements``, ``found`` and
    ``roster`` as in ``strangers``.

    Findings are (consumer, library, finding, detail): unexplained, stale reason, disagreement (a row per level), stranger
    (a row per declaration) and unread.
    """
    current = fleet.newest(releases, ["library"], "version")
    lost = unreachable.select(F.col("repository").alias("consumer")).distinct()
    seen = spread_join(observations, lost, ["consumer"], "left_anti")
    standings = fleet.judge(seen, current)
    split = fleet.disagreements(spread_join(declarations, lost, ["consumer"], "left_anti"), governed)
    loose = fleet.strangers(found, roster, unreachable.select("repository"), out_of_scope).where("finding = 'stranger'")
    none = F.lit(None).cast("string")
    findings = (
        fleet.explain(standings).select("consumer", "library", "finding", F.col("standing").alias("detail"))
        .unionByName(split.select("consumer", "library", F.lit("disagreement").alias("finding"), F.concat_ws(" ", "key", "level").alias("detail")))
        .unionByName(loose.select(F.col("repository").alias("consumer"), none.alias("library"), "finding", F.col("declaration").alias("detail")))
        .unionByName(unreachable.select(F.col("repository").alias("consumer"), none.alias("library"), F.lit("unread").alias("finding"), F.col("reason").alias("detail")))
    )
    return FleetReport(current, standings, fleet.delivered_levels(seen, standings), findings)
