"""Run ledger: documents are cases, labels are outcomes."""

from pyspark.sql import functions as F

from concord.operators import ledger as h
from concord.queries.registry import query, table


@query("h01_select_cases", "SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') OR source IN ('src3', 'src4')")
def h01(spark, sf):
    cases = table(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return h.select_cases(cases, "doc_id", "tags", any_of=["fr", "de", "src3", "src4"]).select("doc_id")


@query(
    "h02_dependent_status",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END WHEN lang = 'fr' THEN 'skip' ELSE 'fail' END AS status
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def h02(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    status = h.dependent_status(
        F.when(F.col("quality") == 1, "pass").otherwise("fail"), F.col("quality").isNotNull(), F.when(F.col("lang") == "fr", "failure").otherwise("success")
    )
    return joined.select("doc_id", status.alias("status"))


def run(spark, sf):
    """Outcomes of labelled documents, exceptions for some sources, and the selected languages."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "lang", "source")
    key = [F.lit("spark").alias("library"), F.lit("parse").alias("assertion")]
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), "quality", "toxic")
    selected = docs.where("lang <> 'de'")
    status = (
        F.when(F.col("lang") == "es", "skip").when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "pass").otherwise("fail")
    )
    outcomes = labels.join(selected, "case_id").select("case_id", *key, status.alias("status"))
    exceptions = docs.where("source IN ('src1', 'src2', 'src3', 'src5', 'src8', 'src13')").select("case_id", *key)
    return outcomes, exceptions, selected


RUN = """
WITH o AS (SELECT doc_id AS case_id, CASE WHEN lang = 'es' THEN 'skip' WHEN toxic = 1 THEN 'error' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS status
           FROM labels JOIN documents USING (doc_id) WHERE lang <> 'de'),
x AS (SELECT doc_id AS case_id, lang, status,
             CASE WHEN lang = 'de' THEN 'unselected' WHEN status IS NULL THEN 'unexercisable' WHEN status = 'skip' THEN 'deferred' WHEN status = 'pass' THEN 'stale'
                  WHEN status = 'fail' THEN 'outstanding' ELSE 'none' END AS bucket
      FROM documents d LEFT JOIN o ON d.doc_id = o.case_id WHERE source IN ('src1', 'src2', 'src3', 'src5', 'src8', 'src13')),
b AS (SELECT case_id, status FROM o WHERE status = 'error' OR (status = 'fail' AND case_id NOT IN (SELECT case_id FROM x WHERE bucket = 'outstanding')))
"""


@query("h03_reconcile", RUN + "SELECT case_id, bucket FROM x")
def h03(spark, sf):
    return h.reconcile(*run(spark, sf)).select("case_id", "bucket")


@query("h04_blocking", RUN + "SELECT case_id, status FROM b")
def h04(spark, sf):
    outcomes, exceptions, selected = run(spark, sf)
    return h.blocking(outcomes, h.reconcile(outcomes, exceptions, selected)).select("case_id", "status")


@query(
    "h05_run_summary",
    RUN
    + """, c AS (SELECT count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'skip') AS skip,
              count(*) FILTER (status = 'error') AS error FROM o)
       SELECT c.*, (SELECT count(*) FROM x WHERE bucket = 'stale') AS stale, (SELECT count(*) FROM x WHERE bucket = 'unexercisable') AS unexercisable,
              (SELECT count(*) FROM b) AS blocking, false AS green FROM c""",
)
def h05(spark, sf):
    outcomes, exceptions, selected = run(spark, sf)
    return h.run_summary(outcomes, h.reconcile(outcomes, exceptions, selected))


@query(
    "h06_coverage",
    "SELECT lang AS label, count(*) AS cases FROM documents GROUP BY 1 UNION ALL SELECT source, count(*) FROM documents GROUP BY 1",
)
def h06(spark, sf):
    cases = table(spark, sf, "documents").select(F.array("lang", "source", "lang").alias("tags"))
    return h.coverage_by(cases, "tags")


@query(
    "h07_index_agreement",
    """SELECT c_custkey, 'c_name' AS field, 'value' AS kind FROM customer WHERE c_mktsegment = 'BUILDING'
       UNION ALL SELECT c_custkey, 'tags', 'value' FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'FURNITURE'
       UNION ALL SELECT c_custkey, NULL, 'extra' FROM customer WHERE c_mktsegment = 'FURNITURE'""",
)
def h07(spark, sf):
    c = table(spark, sf, "customer")
    seg, poor = F.col("c_mktsegment"), F.col("c_acctbal") < 0
    index = c.select("c_custkey", F.when(seg == "BUILDING", F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"),
                     F.array(seg, F.lit("a"), seg).alias("tags"))
    stored = c.where("c_mktsegment <> 'FURNITURE'").select("c_custkey", "c_name", F.when(poor, F.array(seg)).otherwise(F.array(F.lit("a"), seg)).alias("tags"))
    return h.diff_index(index, stored, ["c_custkey"], ["c_name", "tags"]).select("c_custkey", "field", "kind")


@query(
    "h08_orphans",
    """WITH i AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING')
       SELECT k AS case_id, 'stored, not indexed' AS finding FROM s WHERE k NOT IN (SELECT k FROM i)
       UNION ALL SELECT k, 'indexed, not stored' FROM i WHERE k NOT IN (SELECT k FROM s)
       UNION ALL SELECT -1 - s_suppkey, 'exception names no case' FROM supplier""",
)
def h08(spark, sf):
    indexed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("case_id"))
    stored = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("case_id"))
    exceptions = table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("case_id"))
    return h.orphan_report(indexed, stored, exceptions, "case_id")


@query(
    "h09_declared_and_named",
    """SELECT doc_id AS case_id, 'json is declared without expected.json' AS finding FROM documents WHERE lang = 'fr'
       UNION ALL SELECT doc_id, 'expected.diag is named without diag' FROM documents WHERE lang = 'de'
       UNION ALL SELECT doc_id, 'truth and expectation disagree' FROM documents WHERE lang IN ('fr', 'es')""",
)
def h09(spark, sf):
    lang = F.col("lang")
    cases = table(spark, sf, "documents").select(
        F.col("doc_id").alias("case_id"),
        F.array(F.lit("json")).alias("assertions"),
        F.when(lang == "fr", F.array(F.lit("other"))).when(lang == "de", F.array(F.lit("expected.json"), F.lit("expected.diag"))).otherwise(F.array(F.lit("expected.json"))).alias("files"),
        F.when(lang == "es", "convention").otherwise("oracle").alias("truth"),
    )
    return h.check_expectations(cases, [("json", "expected.json"), ("diag", "expected.diag")], "truth", "expected.json")


@query(
    "h10_refused_and_changed",
    """WITH g AS (SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_refused, bool_or(o_totalprice > 250000) AS changed FROM orders GROUP BY 1)
       SELECT * FROM g WHERE all_refused = changed""",
)
def h10(spark, sf):
    return h.check_no_change(table(spark, sf, "orders"), F.col("o_totalprice") > 250000, F.col("o_orderstatus") == "F", ["o_custkey"])


@query(
    "h11_attribution",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_type IN ('click', 'view') THEN 'ok' ELSE 'consumer' END
              WHEN event_type IN ('click', 'view') THEN 'candidate' WHEN value < 10 THEN 'candidate' ELSE 'consumer' END AS whose FROM events""",
)
def h11(spark, sf):
    kind = F.col("event_type")
    base = F.when(kind == "click", F.lit(None).cast("int")).when(kind == "view", 0).otherwise(1)
    errors = F.when(F.col("value") < 10, F.array(kind, F.lit("new"))).otherwise(F.array(kind))
    code = F.when(F.col("user_id") % 3 == 0, 0).otherwise(1)
    return table(spark, sf, "events").select("event_id", h.attribute(base, F.array(kind), code, errors).alias("whose"))


@query(
    "h12_exit_rollup",
    """SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 60) THEN 'failed' WHEN bool_or(event_type = 'view' AND value > 60) THEN 'waiting' ELSE 'ok' END AS exit
       FROM events GROUP BY 1""",
)
def h12(spark, sf):
    state = F.when(F.col("value") > 60, F.col("event_type")).otherwise("fine")
    return h.rollup_exit(table(spark, sf, "events").withColumn("state", state), ["user_id"], "state", ["error"], ["view"])
