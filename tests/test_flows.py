"""Whole texts, models that share names, versions of unlike length, and flows over documents that cannot be read."""

import random
import re

from pyspark.sql import functions as F

from concord.functions.arrays import running_max, running_sum
from concord.functions.versions import normalize_version, version_key
from concord.operators import fleet, scan, validate
from concord.operators.compare import diff_nodes
from concord.operators.nodes import json_nodes
from concord.plans.conformance import conformance_matrix, conformance_run
from concord.plans.sweep import run_sweep
from concord.queries.registry import table


def versions(spark, texts):
    return spark.createDataFrame([(v,) for v in texts], "v string")


def test_versions_of_unlike_length_and_all_tags(spark):
    rising = ["1.0.dev3", "1.0.0a1", "1.0-a.2", "1.0b1", "1.0rc", "1.0rc5", "1.0.0-rc.10", "1.0.0", "1.0.0.post1", "1.0.1", "1.2", "1.10.0.1", "2"]
    key = {r.v: r.k for r in versions(spark, rising).select("v", F.struct(version_key(F.col("v"))).cast("string").alias("k")).collect()}
    order = [r.v for r in versions(spark, reversed(rising)).orderBy(version_key(F.col("v"))).collect()]
    assert order == rising and len(key) == len(rising)
    same = versions(spark, ["30.3"]).select(version_key(F.col("v")) == version_key(F.lit("v30.3.0"))).first()[0]
    assert same
    assert [r[0] for r in versions(spark, ["V1.0-Alpha.1", "1.0+Local.7", "main", "v2024-05-06"]).select(normalize_version("v")).collect()] == ["1.0a1", "1.0+local.7", "main", "2024-05-06"]


def test_newest_of_equal_versions_is_the_same_every_time(spark):
    df = spark.createDataFrame([("g", "1.0"), ("g", "1.0.0"), ("g", "v1.0")], "g string, v string")
    assert {fleet.newest(df.repartition(n), ["g"], "v").first().newest for n in (1, 2, 3)} == {"v1.0"}


VALUE = "model string, object_type string, object_name string, field string, jtype string, num double, str string"


def test_models_do_not_answer_for_one_another(spark):
    objects = spark.createDataFrame([("m1", "Zone", "a"), ("m2", "Zone", "a")], "model string, object_type string, object_name string")
    known = spark.sql("SELECT 'Zone' AS obj_type, 'name' AS field, true AS required, array('Zones') AS reference, CAST(array() AS ARRAY<STRING>) AS object_list UNION ALL SELECT 'Use', 'zone', false, CAST(array() AS ARRAY<STRING>), array('Zones')")
    values = spark.createDataFrame([("m1", "Zone", "a", "name", "string", None, "A"), ("m1", "Use", "u", "zone", "string", None, "a"), ("m2", "Use", "u", "zone", "string", None, "a")], VALUE)
    assert [tuple(r)[:4] for r in validate.check_required(objects, values, known, ["model"]).collect()] == [("m2", "Zone", "a", "name")]
    assert [tuple(r)[:4] for r in validate.check_references(values, known, model=["model"]).collect()] == [("m2", "Use", "u", "zone")]


def test_required_fields_hold_no_table_of_all_values(spark):
    objects = spark.range(20_000).selectExpr("'Zone' AS object_type", "CAST(id AS STRING) AS object_name")
    known = spark.sql("SELECT 'Zone' AS obj_type, 'name' AS field, true AS required")
    values = objects.where("object_name <> '7'").selectExpr("*", "'name' AS field", "'string' AS jtype", "CAST(NULL AS DOUBLE) AS num", "'a' AS str")
    found = validate.check_required(objects, values.unionByName(values), known)
    assert [r.object_name for r in found.collect()] == ["7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "keys=[object_type" not in plan


def test_no_branch_is_no_rule(spark):
    code = validate.value_code(F.array().cast(validate.BRANCHES), F.lit("string"), F.lit(None).cast("double"), F.lit("x"))
    assert spark.range(1).select(code).first()[0] is None


def test_what_could_not_be_read_is_an_error(spark):
    texts = [(1, '{"a":1}', '{"a":1}'), (2, '{"a":1}', '{"a":2}'), (3, "{no", "{no"), (4, None, None), (5, '{"a":1}', None)]
    df = spark.createDataFrame(texts, "case_id int, l string, r string")
    none = spark.createDataFrame([], "case_id int, library string, assertion string")
    run = conformance_run(df, json_nodes(df, ["case_id"], "l"), json_nodes(df, ["case_id"], "r"), none, "x", "json")
    assert {r.case_id: r.status for r in run.outcomes.collect()} == {1: "pass", 2: "fail", 3: "error", 4: "error", 5: "error"}


def test_a_run_reads_every_document_once(spark):
    df = spark.createDataFrame([(1, '{"a":1}', '{"a":1}'), (2, "[1]", "{}"), (3, '{"a":1,"b":[]}', '{"a":2}'), (4, "{", "{}")], "case_id int, l string, r string")
    left, right = (json_nodes(df, ["case_id"], side) for side in "lr")
    accepted = spark.createDataFrame([(3, "x", "json"), (4, "x", "json"), (9, "x", "json")], "case_id int, library string, assertion string")
    run = conformance_run(df.where("case_id > 1"), left, right, accepted, "x", "json")
    assert {(r.case_id, r.ptr, r.kind) for r in run.differences.collect()} == {(2, "", "type"), (3, "/a", "value"), (3, "/b", "extra"), (4, "", "missing")}
    assert sorted((r.case_id, r.status) for r in run.blocking.collect()) == [(2, "fail"), (4, "error")]
    key = [F.lit("x").alias("library"), F.lit("json").alias("assertion")]
    checks = df.select("case_id", *key, F.lit("success").alias("declared"))
    matrix = conformance_matrix(checks, df.select("case_id", key[0], F.lit(True).alias("ok")), left.select("*", *key), right.select("*", key[1]), accepted)
    assert sorted((r.case_id, r.status) for r in matrix.outcomes.collect()) == [(1, "pass"), (2, "fail"), (3, "fail"), (4, "error")]
    assert sorted((r.case_id, r.status) for r in matrix.blocking.collect()) == [(2, "fail"), (4, "error")]
    for frame in (run.blocking, run.summary, matrix.blocking):
        assert frame._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 2


def test_a_matrix_broadcasts_no_table_for_the_size_of_its_file(spark, tmp_path):
    # One text many times over: a file of some KB, of which a broadcast holds every row.
    many = spark.range(5_000).selectExpr("id AS case_id", "'{\"a\":[1,2]}' AS j")
    many.coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    df = table(spark, str(tmp_path), "t")
    key = [F.lit("x").alias("library"), F.lit("json").alias("assertion")]
    left, right = (json_nodes(df.select("case_id", "j"), ["case_id"], "j") for _ in range(2))
    checks = df.select("case_id", *key, F.lit("success").alias("declared"))
    accepted = df.where("case_id % 7 = 0").select("case_id", *key)
    read = df.select("case_id", key[0], (F.col("case_id") > 9).alias("ok"))
    run = conformance_matrix(checks, read, left.select("*", *key), right.select("*", key[1]), accepted)
    for frame in (run.outcomes, run.blocking, run.exceptions, run.summary, run.differences):
        assert not re.search(r"BroadcastExchange HashedRelation|BroadcastHashJoin", frame._jdf.queryExecution().executedPlan().toString())
    assert {(r.status, r["count"]) for r in run.outcomes.groupBy("status").count().collect()} == {("pass", 4_990), ("fail", 10)}
    assert sorted(r.case_id for r in run.blocking.collect()) == [1, 2, 3, 4, 5, 6, 8, 9]


def test_a_matrix_moves_its_nodes_once(spark):
    key = "case_id int, library string, assertion string"
    rng = random.Random(3)
    texts = ['{"a":1,"b":{"c":[1,2]}}', '{"a":2,"b":{"c":[1]}}', '{"a":1.0,"b":[]}', '[{"a":null}]', '{"b":{"c":{"0":1}},"d":"x"}', "{no", None]
    made = spark.createDataFrame([(i, x, a, rng.choice(texts)) for i in range(60) for x in "pqr" for a in "st" if rng.random() < 0.9], key + ", j string")
    wanted = spark.createDataFrame([(i, a, rng.choice(texts)) for i in range(60) for a in "st"], "case_id int, assertion string, j string")
    left, right = json_nodes(made, ["case_id", "library", "assertion"], "j"), json_nodes(wanted, ["case_id", "assertion"], "j")
    checks = spark.createDataFrame([(i, x, a, "success") for i in range(50) for x in "pqr" for a in ("s", "t", "parse-outcome")], key + ", declared string")
    read = spark.createDataFrame([(i, x, i % 7 != 0) for i in range(60) for x in "pqr"], "case_id int, library string, ok boolean")
    run = conformance_matrix(checks, read, left, right, spark.createDataFrame([], key))
    # What is expected, spelled out for every library, meets by a full outer join.
    compared = checks.where("assertion <> 'parse-outcome' AND case_id % 7 <> 0").drop("declared")
    spelled = diff_nodes(left, right.join(compared, ["case_id", "assertion"]), ["case_id", "library", "assertion"], compared)
    assert sorted(map(str, run.differences.select(spelled.columns).collect())) == sorted(map(str, spelled.collect())) != []
    counts = {tuple(r[:3]): r["count"] for r in spelled.groupBy("case_id", "library", "assertion").count().collect()}
    assert {tuple(r[:3]): r.differences for r in run.outcomes.where("differences > 0").collect()} == counts
    for frame in (run.outcomes, run.differences):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
        assert "MapInArrow" in plan and not any(re.search(r"ptr|_w\d|_g\b", keys) for keys in dealt)


def test_a_document_met_twice_in_a_matrix(spark):
    key = "case_id int, library string, assertion string"
    made = [(1, "p", "s", '{"a":1}'), (1, "p", "s", '{"a":1}'), (2, "p", "s", '{"a":1}'), (2, "p", "s", '{"a":0}'), (3, "p", "s", '{"a":1}')]
    left = json_nodes(spark.createDataFrame(made, key + ", j string"), ["case_id", "library", "assertion"], "j")
    wanted = [(1, "s", '{"a":1}'), (2, "s", '{"a":1}'), (3, "s", '{"a":1}'), (3, "s", '{"a":0}')]
    right = json_nodes(spark.createDataFrame(wanted, "case_id int, assertion string, j string"), ["case_id", "assertion"], "j")
    checks = spark.createDataFrame([(i, "p", "s", "success") for i in (1, 2, 3)], key + ", declared string")
    read = spark.createDataFrame([(i, "p", True) for i in (1, 2, 3)], "case_id int, library string, ok boolean")
    run = conformance_matrix(checks, read, left, right, spark.createDataFrame([], key))
    assert {r.case_id: r.status for r in run.outcomes.collect()} == {1: "pass", 2: "fail", 3: "fail"}


def test_a_compact_table_is_dealt_out_by_its_rows(spark, tmp_path):
    spark.range(1_650_000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    dealt = table(spark, str(tmp_path), "t", spread=True).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in dealt) == 1_650_000 and max(r["count"] for r in dealt) < 110_000


def test_sweep_of_two_sides_counts_every_difference(spark):
    rows = [(side, f"f{n}", "{" + ",".join(f'"k{i}":{i + (side == "b")}' for i in range(30)) + "}") for side in "ab" for n in range(2)]
    df = spark.createDataFrame(rows, "side string, file string, json string")
    nodes = json_nodes(df, ["file", "side"], "json")
    outcomes = df.select("file", "side", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    flow = run_sweep(nodes, outcomes, "file", ["a", "b"], per_file=7)
    assert flow.differences.count() == 14
    totals = flow.totals.first()
    assert totals.differences_total == 60 == flow.groups.agg(F.sum("occurrences")).first()[0]
    assert flow.families.agg(F.sum("occurrences")).first()[0] == 60


def test_strangers_in_long_texts_and_long_lines(spark):
    long = "x\n" * 1_100_000 + "release 26.1 here"
    wide = "y" * 300 + " 26.1 # ignore me"
    files = spark.createDataFrame([("p", "a", long), ("p", "b", wide), ("p", "c", "y" * 300 + " 26.1")], "project string, path string, content string")
    none = spark.createDataFrame([], "project string, path string, pattern string")
    found = scan.stranger_occurrences(files, ["project", "path"], "path", "content", scan.spellings(26, 1, 0), none, [], ["# ignore me"]).collect()
    assert sorted((r.path, r.line, len(r.shown)) for r in found) == [("a", 1_100_001, 17), ("c", 1, 200)]


def plain_spellings(text, major, minor, patch):
    """(begin, found): numbers with what parts them, judged one by one."""
    out, last = [], -1
    numbers = list(re.finditer(r"\d+", text))
    for i, m in enumerate(numbers):
        if m[0] != str(major) or m.start() < last or i + 1 == len(numbers) or numbers[i + 1][0] != str(minor):
            continue
        gap = lambda j: text[numbers[j].end() : numbers[j + 1].start()] if j + 1 < len(numbers) else ""
        sep, begin, end = gap(i), m.start(), numbers[i + 1].end()
        front = text[begin - 1 : begin]
        if sep in (".", "-"):
            more = gap(i + 1) == sep
            if more and numbers[i + 2][0] == str(patch) and gap(i + 2) != sep:
                end, more = numbers[i + 2].end(), False
            if more or front == sep:
                continue
            if front in ("v", "V") and not re.match(r"[\d" + sep + "]", text[begin - 2 : begin - 1] if begin > 1 else "x"):
                begin -= 1
        elif sep != "_":
            if not (re.fullmatch(r",\s*", sep) and re.fullmatch(r",\s*", gap(i + 1)) and numbers[i + 2][0] == str(patch)):
                continue
            end = numbers[i + 2].end()
        out.append((begin, text[begin:end]))
        last = end
    return out


def test_spellings_against_a_plain_search(spark):
    said = {"26.1": 1, "v26.1.0": 1, "26-1": 1, "26_1": 1, "26, 1, 0": 1, "0.26.1": 0, "26.10": 0, "2026-10-13": 0, "26.1.0.5": 0, "26.1.": 1, "1v26.1": 1, "-26-1": 0, "1_26_1": 1, "26,1": 0, "126.1": 0, "V26-1-0": 1}
    rng = random.Random(3)
    texts = [*said] + ["".join(rng.choice(["26", "1", "0", "26.1", "26-1", ".", "-", "_", ", ", ",", "v", "x", "\n", " ", "é"]) for _ in range(rng.randrange(25))) for _ in range(1500)]
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    found = {}
    for r in scan.occurrences(files, ["id"], "content", scan.spellings(26, 1, 0)).collect():
        found.setdefault(r.id, []).append((r.begin, r.found))
        text = texts[r.id]
        assert text[r.begin : r.stop] == r.found and r.line == text.count("\n", 0, r.begin) + 1 and r.shown == text.split("\n")[r.line - 1].strip()
    assert [len(found.get(i, [])) for i in range(len(said))] == list(said.values())
    assert {i: sorted(x) for i, x in found.items()} == {i: x for i, t in enumerate(texts) if (x := plain_spellings(t, 26, 1, 0))}


def test_matches_of_files_of_one_key_stay_apart(spark):
    files = spark.createDataFrame([("a", "x 26.1"), ("a", "\n\nlong before 26.1"), ("b", "none")], "path string, content string")
    found = scan.occurrences(files, ["path"], "content", r"26\.1").collect()
    assert sorted((r.path, r.begin, r.line, r.shown) for r in found) == [("a", 2, 1, "x 26.1"), ("a", 14, 3, "long before 26.1")]


def test_many_matches_in_one_text(spark):
    text = "ab\n" * 5_000 + "abab"
    files = spark.createDataFrame([(1, text)], "id int, content string")
    found = scan.occurrences(files, ["id"], "content", "b").orderBy("begin").collect()
    assert [(r.begin, r.line) for r in found] == [(m.start(), text.count("\n", 0, m.start()) + 1) for m in re.finditer("b", text)]


def test_running_values(spark):
    rng = random.Random(2)
    rows = [[rng.randint(-9, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 4_096, 4_097, 9_000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<long>")
    got = df.select(running_sum(F.col("x")).alias("s"), running_max(F.col("x"), -99).alias("m")).orderBy("i").collect()
    for r, x in zip(got, rows):
        assert r.s == [sum(x[:i]) for i in range(len(x))] and r.m == [max(x[:i], default=-99) for i in range(len(x))]


def test_a_stale_statement_has_its_line(spark):
    files = spark.createDataFrame([("a", "one\n release\n  = 9.6.0 here\n"), ("a", "x")], "path string, content string")
    declared = spark.createDataFrame([("a", r"release\s+= ([0-9.]+)", 1, "full")], "path string, pattern string, occurrences int, form string")
    found = scan.check_statements(files, ["path"], "content", declared, (26, 1, 0)).collect()
    assert sorted((r.finding, r.line, r.found, r.expected, r.shown) for r in found if r.line) == [("stale", 3, "9.6.0", "26.1.0", "release")]
    assert [r.finding for r in found if r.line is None] == ["missing"]


def test_an_unknown_form_is_a_finding(spark):
    files = spark.createDataFrame([("a", "v 26.1")], "path string, content string")
    declared = spark.createDataFrame([("a", r"v ([0-9.]+)", 1, "roman")], "path string, pattern string, occurrences int, form string")
    found = scan.check_statements(files, ["path"], "content", declared, (26, 1, 0)).collect()
    assert [(r.finding, r.found, r.expected) for r in found] == [("stale", "26.1", "unknown form roman")]


def test_every_statement_form(spark):
    said = {"full": "9.6.0", "line": "9.6", "dashed": "9-6-0", "dashed-line": "9-6", "underscored-line": "9_6", "tag": "v9.6.0", "directory": "V9-6-0", "tuple": "9, 6, 0", "count": "3", "count-word": "Three"}
    want = {"full": "26.1.0", "line": "26.1", "dashed": "26-1-0", "dashed-line": "26-1", "underscored-line": "26_1", "tag": "v26.1.0", "directory": "V26-1-0", "tuple": "26, 1, 0", "count": "21", "count-word": "Twenty-one"}
    files = spark.createDataFrame([(f, f"<{t}>") for f, t in said.items()], "path string, content string")
    declared = files.select("path", F.lit("<(.*)>").alias("pattern"), F.lit(1).alias("occurrences"), F.col("path").alias("form"))
    found = scan.check_statements(files, ["path"], "content", declared, (26, 1, 0), 21).collect()
    assert {r.path: (r.finding, r.expected) for r in found} == {f: ("stale", t) for f, t in want.items()}
    again = files.select("path", F.concat(F.lit("<"), F.element_at(F.create_map(*[F.lit(x) for p in want.items() for x in p]), F.col("path")), F.lit(">")).alias("content"))
    assert scan.check_statements(again, ["path"], "content", declared, (26, 1, 0), 21).count() == 0
    assert [scan.number_word(n) for n in (0, 19, 20, 42, 99, 100)] == ["zero", "nineteen", "twenty", "forty-two", "ninety-nine", "100"]


def test_changes_without_effect_are_listed(spark):
    from concord.operators.normalise import apply_patches, patch_rejects

    df = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, v double")
    rows = [(1, "remove", 1, None, None), (2, "set-field", 1, "v", "9"), (3, "add", 1, "v", "1"), (4, "set-field", 1, "v", "x"), (5, "add", 2, "v", "2"), (6, "set-field", 7, "v", "2"), (7, "set-field", 2, "w", "2")]
    ops = spark.createDataFrame(rows, "seq int, op string, k int, field string, value string")
    found = patch_rejects(df, ops, "k", {"v": "double"}).collect()
    assert sorted((r.seq, r.reason) for r in found) == [(2, "no object"), (4, "unreadable"), (5, "exists"), (6, "no object"), (7, "unknown field")]
    assert {r.k: r.v for r in apply_patches(df, ops.where("seq in (1, 3, 4)"), "k", {"v": "double"}).collect()} == {1: 1.0, 2: 6.0}
