"""Composed flows over the driver's tables."""

from pyspark.sql import functions as F

from concord.operators import rings as r
from concord.operators.ledger import select_cases
from concord.plans.checks import monthly_check, ring_check
from concord.plans.conformance import PARSE_OUTCOME, conformance_matrix, conformance_run
from concord.plans.surveys import fleet_run, scan_run
from concord.plans.sweep import run_sweep
from concord.queries.b_compare import event_docs
from concord.queries.c_sweep import DIFFS, SIDES, part_nodes
from concord.queries.g_rings import parts
from concord.queries.j_versions import observations
from concord.queries.k_scan import PLANTED, declared_statements, released
from concord.queries.registry import query, table


@query(
    "m01_conformance_run",
    """SELECT count(*) FILTER (event_type = 'purchase') AS pass, count(*) FILTER (event_type <> 'purchase') AS fail, 0::BIGINT AS skip, 0::BIGINT AS error,
              count(*) FILTER (event_type = 'purchase' AND user_id < 20) AS stale, 0::BIGINT AS unexercisable,
              count(*) FILTER (event_type IN ('click', 'error') OR (event_type = 'signup' AND user_id >= 20)) AS blocking, false AS green
       FROM events WHERE event_type <> 'view'""",
)
def m01(spark, sf):
    e = table(spark, sf, "events")
    cases = select_cases(e.select(F.col("event_id").alias("case_id"), F.array("event_type").alias("tags")), "case_id", "tags", any_of=["click", "error", "signup", "purchase"])
    left, right = (nodes.withColumnRenamed("event_id", "case_id") for nodes in event_docs(spark, sf))
    accepted = e.where("user_id < 20 AND event_type IN ('signup', 'purchase', 'view')").select(
        F.col("event_id").alias("case_id"), F.lit("spark").alias("library"), F.lit("json").alias("assertion")
    )
    return conformance_run(cases, left, right, accepted, "spark", "json").summary


def part_sweep(spark, sf):
    """A sweep of parts by brand. Forty differences a brand are listed; groups and totals are of all."""
    brands = table(spark, sf, "part").select("p_brand").distinct()
    outcomes = brands.select("p_brand", F.explode(F.array(*[F.lit(s) for s in SIDES])).alias("side")).select(
        "p_brand", "side", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")
    )
    return run_sweep(part_nodes(spark, sf), outcomes, "p_brand", SIDES, per_file=40, nested=False)


@query("m02_sweep_groups", DIFFS + "SELECT shape, count(*) AS occurrences, count(DISTINCT p_brand) AS file_count FROM diffs GROUP BY shape")
def m02(spark, sf):
    return part_sweep(spark, sf).groups.select("shape", "occurrences", "file_count")


@query(
    "m05_sweep_totals",
    DIFFS
    + """SELECT (SELECT count(DISTINCT p_brand) FROM part) AS files_seen, count(DISTINCT p_brand) AS files_with_differences,
              count(*) AS differences_total, count(DISTINCT shape) AS shapes FROM diffs""",
)
def m05(spark, sf):
    totals = part_sweep(spark, sf)
    shapes = totals.groups.agg(F.countDistinct("shape").alias("shapes"))
    return totals.totals.select("files_seen", "files_with_differences", "differences_total").join(F.broadcast(shapes))


@query(
    "m03_monthly_check",
    """WITH m AS (SELECT o_orderpriority, month(o_orderdate) AS month, avg(o_totalprice) AS mean FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice <> 99999 GROUP BY ALL)
       SELECT s.o_orderpriority, s.month::INTEGER AS month, s.month <> 6 AND mean IS NOT NULL AS passed
       FROM (SELECT DISTINCT o_orderpriority, unnest(generate_series(1, 12)) AS month FROM orders) s LEFT JOIN m USING (o_orderpriority, month)""",
)
def m03(spark, sf):
    o = table(spark, sf, "orders")
    hourly = o.withColumn("price", F.when(F.col("o_orderstatus") == "P", 99999.0).otherwise(F.col("o_totalprice")))
    # The published figures: means of what was measured with two decimals, June misprinted.
    printed = o.where("o_orderstatus <> 'P' AND o_totalprice <> 99999").groupBy("o_orderpriority", F.month("o_orderdate").alias("month")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("v")
    )
    by_month = [F.coalesce(F.max(F.when(F.col("month") == m, F.col("v"))), F.lit(0.0)) + (0.5 if m == 6 else 0.0) for m in range(1, 13)]
    expected = printed.groupBy("o_orderpriority").agg(F.array(*by_month).alias("monthly")).select(
        "*", F.lit(True).alias("covered"), F.lit(None).cast("string").alias("reason"), F.lit(0.0051).alias("tolerance")
    )
    checked = monthly_check(hourly, ["o_orderpriority"], F.month("o_orderdate"), "price", [99999.0], expected)
    return checked.select("o_orderpriority", "month", "passed")


@query(
    "m04_ring_check",
    """SELECT label AS model, CASE WHEN label = 2 THEN 0 ELSE count(*) END AS compared,
              CASE WHEN label IN (2, 4) THEN count(*) ELSE 0 END AS failures
       FROM embeddings GROUP BY label""",
)
def m04(spark, sf):
    rings, rules, zones = parts(spark, sf)
    world = r.to_world(rings, rules, zones).withColumn("base_surface", F.lit(""))
    # Model 4 is reported half a metre off; model 2 was not resolved at all.
    off = F.when(F.col("model") == 4, 0.5).otherwise(0.0)
    reported = world.withColumn("vertices", F.transform("vertices", lambda v: F.struct(v["x"].alias("x"), (v["y"] + off).alias("y"), v["z"].alias("z"))))
    resolved = rings.where("model <> 2").withColumn("parent", F.lit(None).cast("string"))
    nothing = rules.limit(0).select("model")
    return ring_check(resolved, rules, zones, reported, nothing).select("model", "compared", "failures")


def event_matrix(spark, sf):
    """Two libraries and two assertions. The first reads every document; the second none of the kinds error (declared to fail)
    and view, and makes of all others what is expected."""
    e = table(spark, sf, "events")
    case, kind = F.col("event_id").alias("case_id"), F.col("event_type")
    left, right = (nodes.withColumnRenamed("event_id", "case_id") for nodes in event_docs(spark, sf))
    libraries = F.explode(F.array(F.lit("first"), F.lit("second")))
    checks = e.select(case, libraries.alias("library"), F.when(kind == "error", "failure").otherwise("success").alias("declared")).withColumn(
        "assertion", F.explode(F.array(F.lit(PARSE_OUTCOME), F.lit("json")))
    )
    read = e.select(case, libraries.alias("library"), kind).select("case_id", "library", ((F.col("library") == "first") | ~kind.isin("error", "view")).alias("ok"))
    json = F.lit("json").alias("assertion")
    made = left.select("*", F.lit("first").alias("library"), json).unionByName(right.select("*", F.lit("second").alias("library"), json))
    accepted = e.where("user_id < 20").select(case, F.lit("second").alias("library"), json)
    return conformance_matrix(checks, read, made, right.select("*", json), accepted)


MATRIX = """
WITH m AS (SELECT event_id AS case_id, library, assertion, user_id,
                  CASE WHEN assertion = 'parse-outcome' THEN CASE WHEN (library = 'first') = (event_type = 'error') AND NOT (library = 'second' AND event_type NOT IN ('error', 'view')) THEN 'fail' ELSE 'pass' END
                       WHEN library = 'first' THEN CASE WHEN event_type = 'purchase' THEN 'pass' ELSE 'fail' END
                       ELSE CASE event_type WHEN 'error' THEN 'skip' WHEN 'view' THEN 'fail' ELSE 'pass' END END AS status
           FROM events, (VALUES ('first'), ('second')) l(library), (VALUES ('parse-outcome'), ('json')) a(assertion))
"""


@query("m06_conformance_matrix", MATRIX + "SELECT case_id, library, assertion, status FROM m")
def m06(spark, sf):
    return event_matrix(spark, sf).outcomes.select("case_id", "library", "assertion", "status")


@query("m06_matrix_blocking", MATRIX + "SELECT case_id, library, assertion FROM m WHERE status = 'fail' AND NOT (user_id < 20 AND library = 'second' AND assertion = 'json')")
def m06_blocking(spark, sf):
    return event_matrix(spark, sf).blocking.select("case_id", "library", "assertion")


def corpus_report(spark, sf):
    """Documents as files of a roster: two projects lag, one is listed without files, one could not be read, one declares nothing."""
    files = released(spark, sf)
    projects = files.select("project").distinct()
    roster = projects.select("project", F.col("project").isin("src1", "src2").alias("lags")).unionByName(
        projects.select(F.concat("project", F.lit("-archive")).alias("project"), F.lit(False).alias("lags"))
    )
    failed = projects.where("project = 'src4'").withColumn("reason", F.lit("timeout"))
    declared = declared_statements(spark, sf).join(files.select("doc_id", "project", "path"), "doc_id").where("project <> 'src3'").drop("doc_id")
    return scan_run(files, "project", "path", "content", roster, failed, declared, (26, 1, 0))


@query(
    "m07_scan_findings",
    PLANTED
    + """, d AS (SELECT source AS project, lang || '/d' || doc_id || '.txt' AS path, * FROM documents WHERE source <> 'src4')
       SELECT project, path, 'missing' AS finding, NULL::BIGINT AS line, NULL AS found, NULL AS expected FROM d WHERE lang IN ('de', 'es') AND source NOT IN ('src1', 'src2', 'src3')
       UNION ALL SELECT d.project, d.path, 'stale', p.line, p.found, '26-1' FROM d JOIN p USING (doc_id) WHERE d.lang = 'fr' AND d.source NOT IN ('src1', 'src2', 'src3')
       UNION ALL SELECT d.project, d.path, 'stranger', p.line, p.found, NULL FROM d JOIN p USING (doc_id) WHERE d.source = 'src3'""",
)
def m07(spark, sf):
    return corpus_report(spark, sf).findings.select("project", "path", "finding", "line", "found", "expected")


@query(
    "m07_scan_unread",
    "SELECT DISTINCT source || '-archive' AS project, 'no files are listed' AS reason FROM documents UNION ALL SELECT DISTINCT source, 'timeout' FROM documents WHERE source = 'src4'",
)
def m07_unread(spark, sf):
    return corpus_report(spark, sf).unread


@query(
    "m08_fleet_findings",
    """WITH r AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, o_orderkey, o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey % 3 || '.0' END AS level,
                         o_orderpriority = '1-URGENT' AND c_mktsegment = 'HOUSEHOLD' AS bad FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 4),
            g AS (SELECT c_custkey, c_mktsegment, any_value(c_acctbal) AS bal, bool_or(bad) AS bad, bool_or(o_orderstatus = 'O') AS own,
                         arg_min(coalesce(level, '-'), o_orderkey) FILTER (o_orderstatus = 'O') AS lvl, bool_or(o_orderstatus <> 'O' AND level IS NULL) AS unpinned FROM r GROUP BY ALL),
            st AS (SELECT c_custkey, c_mktsegment, bal < 0 AS lag, CASE WHEN bad THEN 'unread' WHEN own THEN CASE lvl WHEN '-' THEN 'unpinned' WHEN '2.0' THEN 'current' ELSE 'behind' END
                                                                   WHEN unpinned THEN 'unpinned' ELSE 'via-provider' END AS standing FROM g),
            dis AS (SELECT DISTINCT c_custkey, c_mktsegment, level FROM r WHERE o_orderstatus = 'O' AND level IS NOT NULL)
       SELECT c_custkey::VARCHAR AS consumer, c_mktsegment AS library, CASE WHEN lag THEN 'stale reason' ELSE 'unexplained' END AS finding, standing AS detail
       FROM st WHERE (standing IN ('behind', 'unpinned') AND NOT lag) OR (standing = 'current' AND lag)
       UNION ALL SELECT c_custkey::VARCHAR, c_mktsegment, 'disagreement', c_mktsegment || '-release ' || level FROM dis
                 WHERE (c_custkey, c_mktsegment) IN (SELECT (c_custkey, c_mktsegment) FROM dis GROUP BY ALL HAVING count(*) > 1)
       UNION ALL SELECT DISTINCT c_custkey::VARCHAR, NULL, 'stranger', 'orders: ' || o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey > 20
       UNION ALL SELECT c_custkey::VARCHAR, NULL, 'unread', 'timeout' FROM customer WHERE c_nationkey = 4""",
)
def m08(spark, sf):
    # Nations above 20 are not on the roster; those of nation 4 could not be read. A segment's release is a package of its own.
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    name = F.col("c_custkey").cast("string")
    seen = observations(spark, sf).withColumn("consumer", F.col("consumer").cast("string"))
    segments = c.select(F.col("c_mktsegment").alias("library")).distinct()
    releases = segments.select("library", F.explode(F.array(F.lit("v1.9"), F.lit("v2.0"), F.lit("2.0rc1"))).alias("version"))
    stated = seen.where("own").select("consumer", "library", F.lit("core").alias("package"), "level")
    governed = {s: ["core"] for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    lost = c.where("c_nationkey = 4").select(name.alias("repository"), F.lit("timeout").alias("reason"))
    found = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(name.alias("repository"), F.lit("orders").alias("path"), F.col("o_orderpriority").alias("package"))
    roster = c.where("c_nationkey <= 20").select(name.alias("repository"))
    return fleet_run(seen, releases, stated, governed, lost, found, roster).findings
