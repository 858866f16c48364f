"""A conformance run: compare documents case by case, then join the outcomes to the register."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.compare import diff_nodes
from concord.operators.ledger import OUTCOME_KEY, blocking_of, dependent_status, reconcile, run_totals

# The check that a document is read where success is declared, and refused where failure is.
PARSE_OUTCOME = "parse-outcome"


@dataclass(frozen=True)
class Run:
    differences: DataFrame
    outcomes: DataFrame
    exceptions: DataFrame
    blocking: DataFrame
    summary: DataFrame


def _counted(found: DataFrame, ids: list[str]) -> DataFrame:
    """Per document its differences, and whether both sides could be read: one pass over what ``diff_nodes`` finds with roots."""
    return found.groupBy(*ids).agg(F.count("kind").alias("differences"), F.max("read").alias("_read"))


def _differences(found: DataFrame) -> DataFrame:
    return found.where("kind IS NOT NULL").drop("read")


def conformance_run(cases: DataFrame, left: DataFrame, right: DataFrame, exceptions: DataFrame, library: str, assertion: str) -> Run:
    """``cases`` is (case_id) of the selected cases; ``left`` and ``right`` are node tables by
    case_id; ``exceptions`` is (case_id, library, assertion). A case of which a side has no document
    that could be read (none, null or no JSON) is an ``error``: nothing was compared."""
    selected = cases.select("case_id").distinct()
    found = diff_nodes(left, right, ["case_id"], selected, roots=True)
    status = F.when(~F.coalesce("_read", F.lit(False)), "error").when(F.col("differences") > 0, "fail").otherwise("pass")
    outcomes = selected.join(_counted(found, ["case_id"]), "case_id", "left").select(
        "case_id",
        F.lit(library).alias("library"),
        F.lit(assertion).alias("assertion"),
        status.alias("status"),
        F.coalesce("differences", F.lit(0)).alias("differences"),
    )
    reconciled = reconcile(outcomes, exceptions, selected)
    return Run(_differences(found), outcomes, reconciled, blocking_of(outcomes, exceptions), run_totals(outcomes, exceptions, selected))


def conformance_matrix(checks: DataFrame, read: DataFrame, left: DataFrame, right: DataFrame, exceptions: DataFrame) -> Run:
    """A run of several libraries and assertions in one plan.

    ``checks`` is (case_id, library, assertion, declared) of the selected checks, ``declared`` (success or failure)
    being the case's own; ``read`` is (case_id, library, ok), a missing row is a document that was not read. ``left`` are node
    tables by (case_id, library, assertion), what a library made; ``right`` by (case_id, assertion), what is expected of all.

    PARSE_OUTCOME passes where the reading went as declared. Every other assertion needs a document: without one it is
    skipped where failure is declared and fails elsewhere. Where one was read but a side's nodes lack, it is an error.
    """
    has, at = F.coalesce("ok", F.lit(False)), ["case_id", "library"]
    # The size of a small file, or of what is read from it, tells little of its rows: nothing is to be broadcast for it.
    known = read.groupBy(*at).agg(F.bool_and("ok").alias("ok")).hint("merge")
    selected = checks.select(*OUTCOME_KEY, "declared").repartition(*at).distinct().join(known, at, "left").withColumn("_has", has).drop("ok")
    needed = F.coalesce((F.col("assertion") != PARSE_OUTCOME) & F.col("_has"), F.lit(False))
    compared = selected.where(needed)
    found, unplaced = (diff_nodes(left, right, OUTCOME_KEY, compared.select(*OUTCOME_KEY), roots=True, placed=placed) for placed in (True, False))
    # Of the other checks no document is compared: they stay where they are.
    counted = compared.join(_counted(unplaced, OUTCOME_KEY).hint("merge"), OUTCOME_KEY, "left")
    joined = counted.unionByName(selected.where(~needed), allowMissingColumns=True)
    compare = F.when(~F.coalesce("_read", F.lit(False)), "error").when(F.col("differences") > 0, "fail").otherwise("pass")
    as_declared = F.when(F.col("_has") == (F.col("declared") == "success"), "pass").otherwise("fail")
    status = F.when(F.col("assertion") == PARSE_OUTCOME, as_declared).otherwise(dependent_status(compare, F.col("_has"), F.col("declared")))
    outcomes = joined.select(*OUTCOME_KEY, status.alias("status"), F.coalesce("differences", F.lit(0)).alias("differences"))
    cases, register = checks.select("case_id").distinct().hint("merge"), exceptions.hint("merge")
    reconciled = reconcile(outcomes.hint("merge"), exceptions, cases)
    return Run(_differences(found), outcomes, reconciled, blocking_of(outcomes, register), run_totals(outcomes, exceptions, cases))
