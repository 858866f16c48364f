"""Next actions, runs of several libraries, corpus and fleet reports on small rows."""

from concord.functions.versions import version_key
from concord.operators.fleet import delivered_levels, judge
from concord.operators.nodes import json_nodes
from concord.operators.rollup import next_action
from concord.plans.conformance import PARSE_OUTCOME, conformance_matrix
from concord.plans.surveys import fleet_run, scan_run
from pyspark.sql import functions as F

STEP = "project string, step long, verdict string, landing string, reason string, pull string, opened boolean, lag string"


def owed(spark, rows, strangers=(), openings=None):
    frame = spark.createDataFrame(rows, STEP)
    loose = spark.createDataFrame([(p,) for p in strangers], "project string")
    waits = None if openings is None else spark.createDataFrame(openings, "project string, package string, owner string")
    return sorted(next_action(frame, loose, "project", "step", waits).collect(), key=str)


def test_next_action_by_priority(spark):
    done = ("a", 1, "passed", "released", None, None, True, None)
    review, failed = ("b", 3, "awaiting person", "proposed", "x", "open", True, None), ("c", 2, "failed", "none", "x", None, True, None)
    ready = ("d", 4, "passed", "proposed", None, "open", True, None)
    start = [(p, 5, "not started", "none", "not dispatched", None, True, None) for p in "ef"]
    assert [tuple(r)[:3] for r in owed(spark, [done, review, failed, ready, *start])] == [("resolve the failure", "c", 2)]
    assert [tuple(r)[:3] for r in owed(spark, [done, review, ready, *start])] == [("review", "b", 3)]
    assert [tuple(r)[:3] for r in owed(spark, [done, ready, *start])] == [("merge", "d", None)]
    held = ("d", 9, "not started", "proposed", "x", "open", True, None)
    assert [tuple(r)[:3] for r in owed(spark, [done, ready, held, *start])] == [("start", "e", None), ("start", "f", None)]
    assert [tuple(r)[:2] for r in owed(spark, [done], ["y", "x", "x"])] == [("account for strangers", "x"), ("account for strangers", "y")]
    assert owed(spark, [done]) == [] and owed(spark, []) == []


def test_publication_is_due_once_its_owner_is_done(spark):
    def closed(p, n, lag=None):
        return (p, n, "not started", "none", "waiting on x", None, False, lag)

    rows = [("a", 1, "passed", "merged", None, None, True, None), ("b", 2, "not started", "none", "the run is in progress", None, True, None)]
    rows += [closed("c", 3), closed("d", 4), closed("e", 5), closed("z", 0, "decided")]
    waits = [("c", "late", "b"), ("d", "due", "a"), ("d", "due", "a"), ("e", "due", "a"), ("z", "due", "a"), ("e", "free", None)]
    assert [tuple(r) for r in owed(spark, rows, ["s"], waits)] == [("publish", "d", None, "due", 3)]
    # Nothing of the package's owner is open any more, but only a lagging project waits: strangers are next.
    assert [tuple(r)[:2] for r in owed(spark, rows[:2] + rows[-1:], ["s"], waits)] == [("account for strangers", "s")]
    assert [tuple(r) for r in owed(spark, rows, [], [("e", "free", None), ("e", "Free", None)])] == [("publish", "e", None, "Free", 1)]


def test_long_versions_compare_whole(spark):
    stem = ".".join(["1"] * 14)
    rising = [stem, stem + ".0.2", stem + ".1", "1." + "9" * 30, "2"]
    frame = spark.createDataFrame([(v,) for v in reversed(rising)], "v string").repartition(3)
    assert [r.v for r in frame.orderBy(version_key(F.col("v"))).collect()] == rising
    assert frame.where("v = '2'").select(version_key(F.col("v")) == version_key(F.lit("2" + ".0" * 20))).first()[0]


def test_delivered_levels_are_rows(spark):
    schema = "consumer string, library string, ord long, own boolean, level string, locked string, delivers string, error string, lag string"
    rows = [("a", "l", i, False, "9", None, d, None, None) for i, d in enumerate(("1.0", "2.0", "2.0", None))] + [
        ("b", "l", 0, False, "9", None, "3.0", None, None), ("c", "l", 0, True, "1.0", None, "4.0", None, None),
    ]
    seen = spark.createDataFrame(rows, schema)
    standings = judge(seen, spark.createDataFrame([("l", "1.0.0")], "library string, newest string"))
    assert {(r.consumer, r.level, r.standing) for r in standings.collect()} == {("a", None, "via-provider"), ("b", "3.0", "via-provider"), ("c", "1.0", "behind")}
    assert sorted((r.consumer, r.delivers) for r in delivered_levels(seen, standings).collect()) == [("a", "1.0"), ("a", "2.0"), ("b", "3.0")]


def test_matrix_of_libraries_and_assertions(spark):
    key = "case_id string, library string, assertion string"
    cases = {"good": "success", "odd": "success", "bad": "failure", "lost": "success"}
    checks = spark.createDataFrame([(c, x, a, d) for c, d in cases.items() for x in "pq" for a in (PARSE_OUTCOME, "json")], key + ", declared string")
    read = spark.createDataFrame(
        [("good", "p", True), ("good", "q", True), ("odd", "p", True), ("odd", "q", False), ("bad", "p", False), ("bad", "q", True), ("lost", "p", True)],
        "case_id string, library string, ok boolean",
    )
    made = spark.createDataFrame([("good", "p", '{"a": 1}'), ("good", "q", '{"a": 2}'), ("odd", "p", '{"a": 1}'), ("bad", "q", "{}"), ("lost", "p", "{}")], "case_id string, library string, j string")
    left = json_nodes(made.withColumn("assertion", F.lit("json")), ["case_id", "library", "assertion"], "j")
    wanted = spark.createDataFrame([("good", '{"a": 1}'), ("odd", '{"a": 1}'), ("bad", "{}")], "case_id string, j string")
    right = json_nodes(wanted.withColumn("assertion", F.lit("json")), ["case_id", "assertion"], "j")
    accepted = spark.createDataFrame([("good", "q", "json"), ("bad", "p", "json"), ("odd", "p", "json"), ("none", "p", "json")], key)
    run = conformance_matrix(checks, read, left, right, accepted)
    out = {(r.case_id, r.library, r.assertion): r.status for r in run.outcomes.collect()}
    p, q = ({c: (out[c, x, PARSE_OUTCOME], out[c, x, "json"]) for c in cases} for x in "pq")
    assert p == {"good": ("pass", "pass"), "odd": ("pass", "pass"), "bad": ("pass", "skip"), "lost": ("pass", "error")}
    assert q == {"good": ("pass", "fail"), "odd": ("fail", "fail"), "bad": ("fail", "pass"), "lost": ("fail", "fail")}
    assert {(r.case_id, r.bucket) for r in run.exceptions.collect()} == {("good", "outstanding"), ("bad", "deferred"), ("odd", "stale"), ("none", "unselected")}
    assert run.blocking.count() == 6 and run.summary.first().stale == 1


def test_scan_report(spark):
    files = spark.createDataFrame(
        [("a", "x.md", "tool 26.1.0\nalso v26-1"), ("b", "x.md", "tool 25.2.0"), ("c", "x.md", "tool 1.0.0"), ("off", "x.md", "26.1.0"), ("z", "x.md", None)],
        "project string, path string, t string",
    )
    roster = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("gone", False), ("z", False)], "project string, lags boolean")
    failed = spark.createDataFrame([("c", "timeout"), ("elsewhere", "timeout")], "project string, reason string")
    rows = [(p, f, r"tool (\d+\.\d+\.\d+)", 1, "full") for p in "abcz" for f in ("x.md",)] + [("a", "y.md", "y", 1, "full")]
    declared = spark.createDataFrame(rows, "project string, path string, pattern string, occurrences int, form string")
    report = scan_run(files, "project", "path", "t", roster, failed, declared, (26, 1, 0))
    got = {(r.project, r.path, r.finding, r.line, r.found) for r in report.findings.collect()}
    assert got == {("a", "x.md", "stranger", 2, "v26-1"), ("a", "y.md", "missing", None, None), ("a", "y.md", "no file", None, None), ("z", "x.md", "missing", None, None)}
    assert {tuple(r) for r in report.unread.collect()} == {("c", "timeout"), ("gone", "no files are listed")}
    assert {tuple(r) for r in report.summary.collect()} == {("a", "stranger", 1), ("a", "missing", 1), ("a", "no file", 1), ("z", "missing", 1)}


def test_fleet_report(spark):
    schema = "consumer string, library string, ord long, own boolean, level string, locked string, delivers string, error string, lag string"
    seen = spark.createDataFrame([("a", "l", 0, True, "1.0", None, None, None, None), ("b", "l", 0, True, "1.10", None, None, None, "old"), ("c", "l", 0, True, "1.0", None, None, None, None)], schema)
    releases = spark.createDataFrame([("l", "1.9"), ("l", "1.10")], "library string, version string")
    stated = spark.createDataFrame([("a", "l", "x", "1.0"), ("a", "l", "y", "1.1"), ("a", "l", "own", "7")], "consumer string, library string, package string, level string")
    lost = spark.createDataFrame([("c", "timeout")], "repository string, reason string")
    found = spark.createDataFrame([("A", "f", "x"), ("s", "f", "x"), ("c", "f", "x")], "repository string, path string, package string")
    report = fleet_run(seen, releases, stated, {"l": ["x", "y"]}, lost, found, spark.createDataFrame([("a",), ("b",)], "repository string"))
    assert {tuple(r) for r in report.findings.collect()} == {
        ("a", "l", "unexplained", "behind"), ("b", "l", "stale reason", "current"), ("a", "l", "disagreement", "l-release 1.0"),
        ("a", "l", "disagreement", "l-release 1.1"), ("s", None, "stranger", "f: x"), ("c", None, "unread", "timeout"),
    }
    assert report.current.first().newest == "1.10"
