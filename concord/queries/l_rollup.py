"""Status rollup: customers are projects, orders their steps, line items members of evidence."""

from pyspark.sql import functions as F

from concord.operators import rollup as r
from concord.operators.skew import spread_join
from concord.queries.registry import query, table


def projects(spark, sf):
    seg, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("project"), F.when(F.col("c_acctbal") < 0, "lags").alias("lag"), (seg != "BUILDING").alias("opened"),
        F.when(seg == "BUILDING", "nation").alias("waits_on"), (seg != "FURNITURE").alias("caller"),
        F.when(seg == "MACHINERY", "open").when(seg == "HOUSEHOLD", "merged").alias("pull"), (nation == 3).alias("base_failing"),
        F.when(nation == 5, "running").when(nation == 6, "failure").when(nation > 9, "success").alias("run"), (nation == 7).alias("run_on_head"),
    )


def steps(spark, sf):
    p, price, status = F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderstatus")
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("step"), (p == "1-URGENT").alias("person"), (p == "2-HIGH").alias("published"),
        (~p.isin("2-HIGH", "5-LOW")).alias("has_command"), (p == "3-MEDIUM").alias("built_outside"), (status == "F").alias("default_holds"),
        (status == "O").alias("head_holds"), (price > 200000).alias("content_holds"),
        F.when(price < 100000, "failure").when(price < 150000, "pending").otherwise("success").alias("checks"),
    )
    return r.verdicts(spread_join(o, projects(spark, sf), ["project"], "inner"))


STEPS = """
WITH s AS (
  SELECT o_custkey AS project, o_orderkey AS step, c_mktsegment AS seg, c_nationkey AS nat, c_acctbal AS bal, o_orderpriority AS p, o_totalprice AS price, o_orderstatus AS st
  FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (SELECT *, CASE
   WHEN bal < 0 THEN 'not applicable|none|lags'
   WHEN st = 'F' THEN CASE WHEN p = '2-HIGH' THEN 'passed|released|' ELSE 'passed|merged|' END
   WHEN seg = 'BUILDING' THEN 'not started|none|waiting on nation'
   WHEN seg = 'FURNITURE' THEN 'not started|none|written when every other step is resolved'
   WHEN seg = 'MACHINERY' THEN CASE
      WHEN st = 'O' THEN 'passed|proposed|'
      WHEN p = '1-URGENT' AND price > 200000 THEN 'awaiting person|proposed|awaiting a review'
      WHEN price < 100000 THEN 'failed|proposed|checks fail'
      WHEN price < 150000 THEN 'not started|proposed|checks are in progress'
      WHEN p = '2-HIGH' THEN 'not started|proposed|waiting on its own library bump'
      WHEN p = '3-MEDIUM' THEN 'not started|proposed|waiting on a build'
      ELSE 'failed|proposed|the branch does not carry this step' END
   WHEN nat = 3 THEN CASE WHEN seg = 'HOUSEHOLD' THEN 'failed|none|fails after the adoption merged' ELSE 'failed|none|failing before any adoption' END
   WHEN nat = 5 THEN 'not started|none|the run is in progress'
   WHEN nat = 6 THEN 'failed|none|the run failed'
   WHEN p = '2-HIGH' THEN 'not started|none|waiting on its own library bump'
   WHEN nat = 7 THEN 'not started|none|ran on this commit and waits'
   ELSE 'not started|none|not dispatched' END AS t FROM s),
r AS (SELECT *, split_part(t, '|', 1) AS verdict, split_part(t, '|', 2) AS landing, nullif(split_part(t, '|', 3), '') AS reason,
             split_part(t, '|', 1) = 'not applicable' OR (split_part(t, '|', 1) = 'passed' AND split_part(t, '|', 2) <> 'proposed') AS resolved FROM v)
"""


@query("l01_verdicts", STEPS + "SELECT project, step, verdict, landing, reason FROM r")
def l01(spark, sf):
    return steps(spark, sf).select("project", "step", "verdict", "landing", "reason")


def line_members(spark, sf):
    """Line items of an order as members of one evidence; prices place them."""
    line = table(spark, sf, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("step"), F.col("l_extendedprice").alias("pos"), (F.col("l_returnflag") != "R").alias("holds"),
        F.concat(F.col("l_linestatus"), F.col("l_partkey").cast("string")).alias("detail"),
    )


@query(
    "l02_all_of",
    """WITH m AS (SELECT l_orderkey AS step, l_extendedprice AS pos, l_returnflag <> 'R' AS holds, l_linestatus || l_partkey AS detail FROM lineitem),
            g AS (SELECT step, bool_and(holds) AS holds, min((pos, detail)) FILTER (NOT holds) AS f FROM m GROUP BY 1)
       SELECT m.step, true AS holds, m.pos, m.detail FROM m JOIN g ON m.step = g.step WHERE g.holds
       UNION ALL SELECT step, false, f[1], f[2] FROM g WHERE NOT holds""",
)
def l02(spark, sf):
    return r.all_of(line_members(spark, sf), ["step"], "pos")


def order_gates(spark, sf):
    openings = line_members(spark, sf).withColumnRenamed("detail", "opening").withColumnRenamed("step", "project")
    return r.gates(openings, "project", "pos")


GATES = """
WITH m AS (SELECT l_orderkey AS project, (l_extendedprice, l_linestatus || l_partkey) AS o, l_returnflag <> 'R' AS holds FROM lineitem),
     g AS (SELECT project, bool_and(holds) AS opened, count(*) FILTER (NOT holds) AS unmet, (min(o) FILTER (NOT holds))[2] AS waits_on FROM m GROUP BY 1)
"""


@query("l03_gates", GATES + "SELECT * FROM g")
def l03(spark, sf):
    return order_gates(spark, sf)


def causes(spark, sf):
    """Strangers, drift and unread projects, by nation and segment."""
    c = table(spark, sf, "customer")
    pick = lambda condition: c.where(condition).select(F.col("c_custkey").alias("project"))
    return pick("c_nationkey = 1"), pick("c_nationkey = 2 AND c_mktsegment = 'HOUSEHOLD'"), pick("c_nationkey = 4 AND c_acctbal > 9000")


@query(
    "l04_complete",
    STEPS
    + """SELECT project, bool_and(resolved) AND NOT any_value(nat = 1 OR (nat = 2 AND seg = 'HOUSEHOLD') OR (nat = 4 AND bal > 9000)) AS complete FROM r GROUP BY 1""",
)
def l04(spark, sf):
    return r.complete(steps(spark, sf), ["project"], *causes(spark, sf))


@query(
    "l05_refusals",
    STEPS
    + """SELECT 'unresolved step' AS cause, project::VARCHAR AS project, step::VARCHAR AS detail FROM r WHERE NOT resolved
         UNION ALL SELECT 'stranger', c_custkey::VARCHAR, NULL FROM customer WHERE c_nationkey = 1
         UNION ALL SELECT 'source changed', c_custkey::VARCHAR, NULL FROM customer WHERE c_nationkey = 2 AND c_mktsegment = 'HOUSEHOLD'
         UNION ALL SELECT 'unread', c_custkey::VARCHAR, NULL FROM customer WHERE c_nationkey = 4 AND c_acctbal > 9000""",
)
def l05(spark, sf):
    return r.refusals(steps(spark, sf), *causes(spark, sf), "project", "step")


@query(
    "l06_next_action",
    STEPS
    + """, f AS (SELECT min(step) AS step FROM r WHERE verdict IN ('awaiting person', 'failed'))
       SELECT CASE verdict WHEN 'failed' THEN 'resolve the failure' ELSE 'review' END AS action, r.project, r.step FROM r JOIN f USING (step)""",
)
def l06(spark, sf):
    return r.next_action(steps(spark, sf), causes(spark, sf)[0], "project", "step").select("action", "project", "step")


# The state of the same steps before any proposal, and with every run still to come or at work.
UNPROPOSED = """
WITH s AS (SELECT o_custkey AS project, o_orderkey AS step, c_mktsegment AS seg, c_nationkey AS nat, c_acctbal < 0 AS lags, o_orderpriority AS p, o_orderstatus AS st
           FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT project, NOT lags AND st <> 'F' AND seg NOT IN ('BUILDING', 'FURNITURE') AND nat <> 5 AND p <> '2-HIGH' AND nat <> 7 AS waits FROM s)
"""


@query("l06_next_start", UNPROPOSED + "SELECT DISTINCT 'start' AS action, project, NULL::BIGINT AS step FROM w WHERE waits")
def l06_start(spark, sf):
    # No project has a proposal or a failure, so the next thing owed is to start.
    none = F.lit(None).cast("string")
    running = F.when(F.col("run") == "running", F.col("run"))
    before = steps(spark, sf).withColumns({"pull": none, "base_failing": F.lit(False), "run": running}).drop("verdict", "landing", "reason")
    return r.next_action(r.verdicts(before), causes(spark, sf)[0], "project", "step").select("action", "project", "step")


@query(
    "l06_next_publish",
    """WITH c AS (SELECT c_custkey AS project, c_nationkey AS nat, c_mktsegment = 'BUILDING' AS shut, c_acctbal < 0 AS lags FROM customer),
            ow AS (SELECT nat, min(project) FILTER (NOT shut) AS owner FROM c GROUP BY 1),
            st AS (SELECT o_custkey AS project, min(o_orderkey) AS at, bool_and(NOT shut OR lags) AS resolved, any_value(nat) AS nat, any_value(shut) AS shut, any_value(lags) AS lags
                   FROM orders JOIN c ON o_custkey = project GROUP BY 1),
            pk AS (SELECT s.nat, count(*) AS waiting, min(s.at) FILTER (NOT s.lags) AS at, arg_min(s.project, s.at) FILTER (NOT s.lags) AS project
                   FROM st s WHERE s.shut GROUP BY 1)
       SELECT 'publish' AS action, pk.project, NULL::BIGINT AS step, 'nation ' || nat AS package, waiting
       FROM pk JOIN ow USING (nat) LEFT JOIN st o ON o.project = ow.owner WHERE coalesce(o.resolved, true) AND pk.at IS NOT NULL ORDER BY pk.at LIMIT 1""",
)
def l06_publish(spark, sf):
    # All that is open is released; closed projects wait on the package of their nation, which its first open customer publishes.
    c = table(spark, sf, "customer")
    shut = F.col("c_mktsegment") == "BUILDING"
    package = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
    owners = c.groupBy("c_nationkey").agg(F.min(F.when(~shut, F.col("c_custkey"))).alias("owner"))
    openings = c.where(shut).join(owners, "c_nationkey").select(F.col("c_custkey").alias("project"), package.alias("package"), "owner")
    released = steps(spark, sf).drop("verdict", "landing", "reason").withColumns({"default_holds": F.col("opened"), "published": F.lit(True)})
    return r.next_action(r.verdicts(released), causes(spark, sf)[0], "project", "step", openings)


@query("l07_sections", GATES + "SELECT opened, waits_on, count(*) AS projects FROM g GROUP BY ALL")
def l07(spark, sf):
    return r.sections(order_gates(spark, sf))


@query("l08_dispatchable", STEPS + "SELECT DISTINCT project FROM r WHERE reason = 'not dispatched'")
def l08(spark, sf):
    return r.dispatchable(steps(spark, sf), "project")


@query("l09_stale", "SELECT event_id, ts < TIMESTAMP '2024-01-12 00:00:00' - INTERVAL 3 DAY AS stale FROM events")
def l09(spark, sf):
    return table(spark, sf, "events").select("event_id", r.is_stale(F.col("ts"), F.lit("2024-01-12 00:00:00").cast("timestamp")).alias("stale"))
