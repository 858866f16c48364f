"""Run outcomes joined to a register of accepted exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.compare import diff

# Fixed values.
STATUSES = ("pass", "fail", "skip", "error")
OUTCOME_KEY = ["case_id", "library", "assertion"]


def select_cases(cases: DataFrame, case_id: str, tags: str, ids: Sequence[str] = (), any_of: Sequence[str] = ()) -> DataFrame:
    """Cases with one of the ids and any of the tags (no list: no condition).

    An unknown id is an error, and so is a selection that meets nothing, unless there is no case. Both fail the query when
    it runs: one aggregation over all cases, of one row, meets every row that is picked or could have been.
    """
    wanted = F.array(*[F.lit(i) for i in dict.fromkeys(ids)]) if ids else None
    picked = F.lit(True)
    if wanted is not None:
        picked &= F.array_contains(wanted, F.col(case_id))
    if any_of:
        picked &= F.coalesce(F.arrays_overlap(F.col(tags), F.array(*[F.lit(t) for t in any_of])), F.lit(False))
    if not ids and not any_of:
        return cases
    known = F.count_distinct(F.when(F.array_contains(wanted, F.col(case_id)), F.col(case_id))) if wanted is not None else F.lit(0)
    met = cases.agg(F.count(F.lit(1)).alias("_all"), F.count_if(picked).alias("_picked"), known.alias("_known"))
    lacking = len(set(ids)) - F.col("_known")
    fault = F.when(lacking > 0, F.concat(lacking.cast("string"), F.lit(" of the ids name no case"))).when(
        (F.col("_picked") == 0) & (F.col("_all") > 0), F.lit("the selection meets no case")
    )
    checked = met.select(F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.lit(True)).cast("boolean").alias("_fine"))
    return cases.where(picked & checked.scalar())


def dependent_status(status: Column, has_document: Column, declared: Column) -> Column:
    """The status of a check that needs a document: without one it is skipped where failure was
    declared and fails elsewhere."""
    return F.when(has_document, status).when(declared == "failure", "skip").otherwise("fail")


def reconcile(outcomes: DataFrame, exceptions: DataFrame, selected: DataFrame) -> DataFrame:
    """Each exception with its bucket: unselected, unexercisable (its case has no such assertion),
    deferred (skipped), stale (passes), outstanding (fails) or, on an error, none."""
    chosen = selected.select("case_id").distinct().withColumn("_selected", F.lit(True))
    held = outcomes.select(*OUTCOME_KEY, "status")
    joined = exceptions.join(chosen, "case_id", "left").join(held, OUTCOME_KEY, "left")
    bucket = (
        F.when(F.col("_selected").isNull(), "unselected")
        .when(F.col("status").isNull(), "unexercisable")
        .when(F.col("status") == "skip", "deferred")
        .when(F.col("status") == "pass", "stale")
        .when(F.col("status") == "fail", "outstanding")
        .otherwise("none")
    )
    return joined.withColumn("bucket", bucket).drop("_selected", "status")


def blocking(outcomes: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Failures that no exception accepts, and every error: an error cannot be accepted."""
    accepted = reconciled.where("bucket = 'outstanding'").select(*OUTCOME_KEY, F.lit("fail").alias("status"))
    return outcomes.where(F.col("status").isin("fail", "error")).join(accepted, [*OUTCOME_KEY, "status"], "left_anti")


def blocking_of(outcomes: DataFrame, exceptions: DataFrame) -> DataFrame:
    """``blocking`` of outcomes that are all of selected cases, straight from the register: an entry that names a failure
    accepts it, so the outcomes need not be worked out once more for its bucket."""
    accepted = exceptions.select(*OUTCOME_KEY, F.lit("fail").alias("status"))
    return outcomes.where(F.col("status").isin("fail", "error")).join(accepted, [*OUTCOME_KEY, "status"], "left_anti")


def run_summary(outcomes: DataFrame, reconciled: DataFrame) -> DataFrame:
    """One row: outcomes per status down to zero, and whether the run is green."""
    counts = outcomes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    buckets = reconciled.agg(
        F.count_if(F.col("bucket") == "stale").alias("stale"), F.count_if(F.col("bucket") == "unexercisable").alias("unexercisable")
    )
    blocked = blocking(outcomes, reconciled).agg(F.count(F.lit(1)).alias("blocking"))
    # Three frames of one row, folded into one.
    parts = counts.unionByName(buckets, allowMissingColumns=True).unionByName(blocked, allowMissingColumns=True)
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    return row.withColumn("green", (F.col("blocking") == 0) & (F.col("stale") == 0) & (F.col("unexercisable") == 0))


def run_totals(outcomes: DataFrame, exceptions: DataFrame, selected: DataFrame) -> DataFrame:
    """``run_summary`` of outcomes (one per key) and the register, each read once: they meet by key and are summed up together."""
    chosen = selected.select("case_id").distinct().withColumn("_selected", F.lit(True))
    register = exceptions.groupBy(*OUTCOME_KEY).agg(F.count(F.lit(1)).alias("_accepted")).join(chosen, "case_id", "left")
    met = outcomes.select(*OUTCOME_KEY, "status").join(register, OUTCOME_KEY, "full_outer")
    status, accepted = F.col("status"), F.coalesce("_selected", F.lit(False))

    def entries(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(accepted & condition, F.col("_accepted"))), F.lit(0))

    row = met.agg(
        *[F.count_if(status == s).alias(s) for s in STATUSES],
        entries(status == "pass").alias("stale"),
        entries(status.isNull()).alias("unexercisable"),
        F.count_if((status == "error") | ((status == "fail") & ~accepted)).alias("blocking"),
    )
    return row.withColumn("green", (F.col("blocking") == 0) & (F.col("stale") == 0) & (F.col("unexercisable") == 0))


def coverage_by(cases: DataFrame, column: str) -> DataFrame:
    """Cases per tag, assertion or truth; an array counts once per distinct member."""
    is_array = dict(cases.dtypes)[column].startswith("array")
    label = F.explode(F.array_distinct(column)) if is_array else F.col(column)
    return cases.select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("cases"))


def diff_index(index: DataFrame, stored: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Indexed against stored records, column by column, arrays as sets."""
    def flat(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.select(
            *keys,
            *[(F.to_json(F.array_sort(F.array_distinct(c))) if kinds[c].startswith("array") else F.col(c)).alias(c) for c in cols],
        )

    return diff(flat(index), flat(stored), keys, cols)


def orphan_report(indexed: DataFrame, stored: DataFrame, exceptions: DataFrame, key: str) -> DataFrame:
    """Indexed without store, stored without index, exceptions naming no case."""
    i, s, e = (df.select(key).distinct() for df in (indexed, stored, exceptions))

    def found(df: DataFrame, what: str) -> DataFrame:
        return df.select(key, F.lit(what).alias("finding"))

    return (
        found(i.join(s, key, "left_anti"), "indexed, not stored")
        .unionByName(found(s.join(i, key, "left_anti"), "stored, not indexed"))
        .unionByName(found(e.join(s, key, "left_anti"), "exception names no case"))
    )


def check_expectations(cases: DataFrame, pairs: Sequence[tuple[str, str]], truth: str, oracle_file: str) -> DataFrame:
    """Cases where a declared assertion lacks its file or a named file its assertion, and cases
    whose truth is not ``oracle`` exactly when the expectation is there.

    ``assertions`` and ``files`` are array columns; ``pairs`` lists (assertion, file).
    """
    findings = [
        F.when(
            F.array_contains("assertions", a) != F.array_contains("files", f),
            F.when(F.array_contains("assertions", a), F.lit(f"{a} is declared without {f}")).otherwise(F.lit(f"{f} is named without {a}")),
        )
        for a, f in pairs
    ]
    oracle = F.when(
        (F.col(truth) == "oracle") != F.array_contains("files", oracle_file), F.lit("truth and expectation disagree")
    )
    rows = F.filter(F.array(*findings, oracle), lambda x: x.isNotNull())
    return cases.select("case_id", F.explode(rows).alias("finding"))


def check_no_change(groups: DataFrame, changed: Column, refused: Column, keys: Sequence[str]) -> DataFrame:
    """Groups that are all refused and yet changed the record, or are not and changed nothing."""
    judged = groups.groupBy(*keys).agg(F.bool_and(refused).alias("all_refused"), F.bool_or(changed).alias("changed"))
    return judged.where(F.col("all_refused") == F.col("changed"))


def attribute(baseline_code: Column, baseline_errors: Column, code: Column, errors: Column) -> Column:
    """Whose failure it is: the candidate's where the baseline passed or did not run, or where new
    error lines appear; the consumer's elsewhere."""
    baseline_fine = baseline_code.isNull() | (baseline_code == 0)
    fresh = F.size(F.array_except(errors, F.coalesce(baseline_errors, F.array().cast("array<string>")))) > 0
    return (
        F.when(code == 0, F.when(baseline_fine, "ok").otherwise("consumer"))
        .when(baseline_fine | fresh, "candidate")
        .otherwise("consumer")
    )


def rollup_exit(states: DataFrame, keys: Sequence[str], state: str, failed: Sequence[str], waiting: Sequence[str]) -> DataFrame:
    """Any failed state: failed; else any waiting one: waiting; else ok."""
    rank = F.when(F.col(state).isin(*failed), 2).when(F.col(state).isin(*waiting), 1).otherwise(0)
    return states.groupBy(*keys).agg(F.max(rank).alias("_rank")).select(
        *keys, F.when(F.col("_rank") == 2, "failed").when(F.col("_rank") == 1, "waiting").otherwise("ok").alias("exit")
    )
