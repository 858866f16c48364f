"""Steps, gates and evidence rolled up to verdicts and what is owed next.

A step row carries its project's state and its own evidence as columns (see ``verdicts``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.skew import spread_join

NOT_DISPATCHED = "not dispatched"

# Fixed value: an evaluation older than this is stale.
STALE_DAYS = 3


def _row(verdict: str, landing: str, reason: str | Column | None) -> Column:
    said = F.lit(reason).cast("string") if reason is None or isinstance(reason, str) else reason
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(landing).alias("landing"), said.alias("reason"))


def verdicts(steps: DataFrame) -> DataFrame:
    """Adds verdict, landing and reason to each step.

    Project columns: lag, opened, waits_on, caller, pull (open, merged or null), base_failing,
    run (running, success, failure or null), run_on_head. Step columns: person, published,
    has_command, built_outside, and the evidence default_holds, head_holds, content_holds and
    checks (failure, pending, success). The first rule that applies decides.
    """
    automated = ~F.col("person")
    own_bump = ~F.col("has_command") & F.col("published")
    before_pull = (
        F.when(
            F.col("base_failing"),
            F.when(F.col("pull") == "merged", _row("failed", "none", "fails after the adoption merged")).otherwise(
                _row("failed", "none", "failing before any adoption")
            ),
        )
        .when(F.col("run") == "running", _row("not started", "none", "the run is in progress"))
        .when(F.col("run") == "failure", _row("failed", "none", "the run failed"))
        .when(own_bump & automated, _row("not started", "none", "waiting on its own library bump"))
        .when(F.coalesce("run_on_head", F.lit(False)), _row("not started", "none", "ran on this commit and waits"))
        .otherwise(_row("not started", "none", NOT_DISPATCHED))
    )
    on_pull = (
        F.when(F.col("head_holds"), _row("passed", "proposed", None))
        .when(F.col("person") & F.col("content_holds"), _row("awaiting person", "proposed", "awaiting a review"))
        .when(F.col("checks") == "failure", _row("failed", "proposed", "checks fail"))
        .when(F.col("checks") == "pending", _row("not started", "proposed", "checks are in progress"))
        .when(own_bump, _row("not started", "proposed", "waiting on its own library bump"))
        .when(F.col("has_command") & F.col("built_outside"), _row("not started", "proposed", "waiting on a build"))
        .otherwise(_row("failed", "proposed", "the branch does not carry this step"))
    )
    row = (
        F.when(F.col("lag").isNotNull(), _row("not applicable", "none", F.col("lag")))
        .when(
            F.col("default_holds"),
            F.when(F.col("published"), _row("passed", "released", None)).otherwise(_row("passed", "merged", None)),
        )
        .when(~F.col("opened"), _row("not started", "none", F.concat(F.lit("waiting on "), F.coalesce("waits_on", F.lit("")))))
        .when(~F.col("caller"), _row("not started", "none", "written when every other step is resolved"))
        .when(F.coalesce(F.col("pull") == "open", F.lit(False)), on_pull)
        .otherwise(before_pull)
    )
    return steps.withColumn("_v", row).select("*", "_v.*").drop("_v")


def all_of(members: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Evidence that holds when all its members do: rows (keys, holds, pos, detail).

    Failing evidence keeps its first failing member, holding evidence a row per member: details are
    rows, never one text that grows with the group.
    """
    judged = members.groupBy(*keys).agg(
        F.bool_and("holds").alias("holds"), F.min(F.when(~F.col("holds"), F.struct(pos, "detail"))).alias("_first")
    )
    failing = judged.where("NOT holds").select(*keys, "holds", f"_first.{pos}", "_first.detail")
    good = judged.where("holds").select(*keys)
    return spread_join(members, good, keys, "left_semi").select(*keys, F.lit(True).alias("holds"), pos, "detail").unionByName(failing)


def gates(openings: DataFrame, project: str, pos: str) -> DataFrame:
    """Each project: whether every opening holds, how many do not, and the first that does not."""
    unmet = ~F.col("holds")
    return openings.groupBy(project).agg(
        F.bool_and("holds").alias("opened"),
        F.count_if(unmet).alias("unmet"),
        F.min(F.when(unmet, F.struct(pos, "opening")))["opening"].alias("waits_on"),
    )


def resolved() -> Column:
    """Not applicable, or passed and more than proposed."""
    return (F.col("verdict") == "not applicable") | ((F.col("verdict") == "passed") & (F.col("landing") != "proposed"))


def complete(rows: DataFrame, keys: Sequence[str], strangers: DataFrame, drift: DataFrame, unread: DataFrame) -> DataFrame:
    """Per key: every step resolved, and no stranger, drift or unread project."""
    out = rows.groupBy(*keys).agg(F.bool_and(resolved()).alias("_resolved"))
    clean = F.lit(True)
    for name, df in (("_strangers", strangers), ("_drift", drift), ("_unread", unread)):
        out = out.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), list(keys), "left")
        clean = clean & F.col(name).isNull()
    return out.select(*keys, (F.col("_resolved") & clean).alias("complete"))


def refusals(rows: DataFrame, strangers: DataFrame, drift: DataFrame, unread: DataFrame, project: str, step: str) -> DataFrame:
    """Every cause that refuses a record: (cause, project, detail)."""
    def cause(df: DataFrame, name: str, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("cause"), F.col(project).cast("string").alias("project"), detail.cast("string").alias("detail"))

    nothing = F.lit(None)
    return (
        cause(rows.where(~resolved()), "unresolved step", F.col(step))
        .unionByName(cause(strangers, "stranger", nothing))
        .unionByName(cause(drift, "source changed", nothing))
        .unionByName(cause(unread, "unread", nothing))
    )


def next_action(rows: DataFrame, strangers: DataFrame, project: str, order: str, openings: DataFrame | None = None) -> DataFrame:
    """What is owed next: rows (action, project, step, package, waiting).

    By priority: the first row that awaits a person or failed; the first project whose proposed
    steps all passed, to be merged; every project not dispatched; the first publication that is due;
    every project with strangers. Only the highest priority with a candidate is returned.

    ``openings`` is (project, package, owner): a closed project waits until the package is published by its
    owner, null where no project is known to publish it. It is due once every step of the owner is resolved;
    ``waiting`` counts the closed projects that wait on it. Projects that lag wait, but make nothing due.

    Steps are summed up by project once; offers and the least of them are taken from those sums.
    """
    at, proposed = F.col(order).cast("long"), F.coalesce((F.col("pull") == "open") & (F.col("landing") == "proposed"), F.lit(False))
    shut = ~F.col("opened")
    states = rows.groupBy(project).agg(
        F.min(F.when(F.col("verdict") == "awaiting person", at)).alias("_review"),
        F.min(F.when(F.col("verdict") == "failed", at)).alias("_failed"),
        F.min(F.when(proposed, at)).alias("_proposed"),
        F.bool_and(~proposed | (F.col("verdict") == "passed")).alias("_ready"),
        F.coalesce(F.bool_or(F.col("reason") == NOT_DISPATCHED), F.lit(False)).alias("_start"),
        F.bool_and(resolved()).alias("_resolved"),
        F.coalesce(F.bool_or(shut), F.lit(False)).alias("_shut"),
        F.min(F.when(shut & F.col("lag").isNull(), at)).alias("_closed"),
    )

    def offer(priority: int, action: str, place: Column, step: Column) -> Column:
        return F.struct(
            F.lit(priority).alias("priority"), place.cast("long").alias("at"), F.lit(action).alias("action"), step.cast("long").alias("step"),
            F.lit(None).cast("string").alias("package"), F.lit(None).cast("long").alias("waiting"),
        )

    none = F.lit(None)
    offered = F.array(
        F.when(F.col("_review").isNotNull(), offer(1, "review", F.col("_review"), F.col("_review"))),
        F.when(F.col("_failed").isNotNull(), offer(1, "resolve the failure", F.col("_failed"), F.col("_failed"))),
        F.when(F.col("_proposed").isNotNull() & F.col("_ready"), offer(2, "merge", F.col("_proposed"), none)),
        F.when(F.col("_start"), offer(3, "start", F.lit(0), none)),
    )
    offers = states.select(project, F.inline(F.filter(offered, lambda o: o.isNotNull())))
    loose = strangers.select(project).distinct().select(project, F.inline(F.array(offer(5, "account for strangers", F.lit(0), none))))
    offers = offers.unionByName(loose)
    if openings is not None:
        offers = offers.unionByName(_publications(states, openings, project))
    # Several packages of one first project: the least name.
    place = F.struct("priority", "at", F.coalesce("package", F.lit("")).alias("package"))
    best = offers.agg(F.min(place).alias("_b"))
    return offers.join(F.broadcast(best), place == F.col("_b")).select("action", project, "step", "package", "waiting")  # one row


def _publications(states: DataFrame, openings: DataFrame, project: str) -> DataFrame:
    """The packages that closed projects wait on and whose owner is done, as offers."""
    waiting = spread_join(openings.select(project, "package", "owner").distinct(), states.where("_shut").select(project, "_closed"), [project], "inner")
    packages = waiting.groupBy("package", "owner").agg(
        F.min(F.when(F.col("_closed").isNotNull(), F.struct(F.col("_closed").alias("at"), F.col(project).alias("project")))).alias("_first"),
        F.count(F.lit(1)).alias("waiting"),
    )
    owing = states.where("NOT _resolved").select(F.col(project).alias("owner"))
    due = packages.where("_first IS NOT NULL").join(owing, "owner", "left_anti")
    return due.select(
        F.col("_first.project").alias(project), F.lit(4).alias("priority"), F.col("_first.at").alias("at"), F.lit("publish").alias("action"),
        F.lit(None).cast("long").alias("step"), "package", "waiting",
    )


def sections(states: DataFrame) -> DataFrame:
    """Projects by whether their gate is open and what it waits on."""
    return states.groupBy("opened", "waits_on").agg(F.count(F.lit(1)).alias("projects"))


def dispatchable(rows: DataFrame, project: str) -> DataFrame:
    """Projects with an open gate, no lag, no open proposal and a step not dispatched."""
    fit = F.col("opened") & F.col("lag").isNull() & (F.coalesce(F.col("pull"), F.lit("")) != "open") & (F.col("reason") == NOT_DISPATCHED)
    return rows.where(fit).select(project).distinct()


def is_stale(evaluated: Column, now: Column) -> Column:
    return evaluated < now - F.expr(f"INTERVAL {STALE_DAYS} DAYS")
