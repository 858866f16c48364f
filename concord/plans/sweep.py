"""An N-way sweep from node tables to groups, families, outcomes and totals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import sweep as s
from concord.sources.report import write_report


@dataclass(frozen=True)
class Sweep:
    differences: DataFrame
    groups: DataFrame
    families: DataFrame
    failures: DataFrame
    totals: DataFrame

    def write(self, path: str) -> None:
        write_report({"totals": self.totals, "groups": self.groups, "families": self.families, "failures": self.failures}, path)


def run_sweep(
    nodes: DataFrame, outcomes: DataFrame, file: str, sides: Sequence[str], per_file: int = 500, per_group: int = 10, nested: bool = True
) -> Sweep:
    """``nodes`` are node tables of all sides with a ``side`` column; ``outcomes`` is (file, side,
    ok, error). Files with fewer than two good sides are counted and not compared. ``per_file`` bounds
    the differences that are listed; groups, families and totals are of all differences."""
    available = outcomes.where("ok").select(file, "side")
    aligned = s.align_sides(nodes, [file], sides, available)
    found = s.sweep_diff(aligned, [file], sides, nested)
    kept = s.cap_per_file(found, [file], [F.col("ord"), F.col("ptr")], per_file)
    return Sweep(
        kept,
        s.ordered_groups(s.group_shapes(found, file, per_group)),
        s.group_families(found, file, per_group),
        s.group_outcomes(outcomes, file, per_group),
        s.sweep_totals(outcomes, found, [file], sides),
    )
