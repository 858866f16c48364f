"""Reserved values and monthly means over orders, line items and events."""

from pyspark.sql import functions as F

from concord.functions.numbers import print_tolerance
from concord.operators import reserved as r
from concord.queries.registry import query, table

MISSING = {"l_tax": [0.08], "l_discount": [0.1, 0.09]}


@query(
    "f01_mask_reserved",
    """SELECT l_returnflag, count(*) AS rows, sum(CASE WHEN l_tax <> 0.08 THEN 1 ELSE 0 END)::BIGINT AS tax_present,
              sum(CASE WHEN l_discount NOT IN (0.1, 0.09) THEN 1 ELSE 0 END)::BIGINT AS discount_present,
              sum(CASE WHEN l_tax = 0.07 THEN 1 ELSE 0 END)::BIGINT AS observations
       FROM lineitem GROUP BY 1""",
)
def f01(spark, sf):
    masked = r.mask_table(table(spark, sf, "lineitem"), MISSING)
    return masked.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("l_tax").alias("tax_present"),
        F.count("l_discount").alias("discount_present"),
        F.count_if(F.col("l_tax") == 0.07).alias("observations"),
    )


def order_means(spark, sf):
    """Stations are order statuses; urgent orders carry the reserved price 99999."""
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(99999.0)).otherwise(F.col("o_totalprice"))
    o = o.where(~((F.col("o_orderstatus") == "F") & (F.month("o_orderdate") == 2)))
    return r.monthly_means(o.withColumn("price", r.mask_reserved(raw, [99999.0])), ["o_orderstatus"], F.month("o_orderdate"), F.col("price"))


MEANS = """
WITH m AS (SELECT s.o_orderstatus, s.month, avg(o_totalprice) AS mean, count(o_totalprice) AS present
           FROM (SELECT DISTINCT o_orderstatus, unnest(generate_series(1, 12)) AS month FROM orders) s
           LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND month(o_orderdate) = s.month AND o_orderpriority <> '1-URGENT'
                AND NOT (o.o_orderstatus = 'F' AND month(o_orderdate) = 2) AND o_totalprice <> 99999
           GROUP BY ALL)
"""


@query("f02_monthly_means", MEANS + "SELECT o_orderstatus, month::INTEGER AS month, round(mean, 6) AS mean, present FROM m")
def f02(spark, sf):
    return order_means(spark, sf).withColumn("mean", F.round("mean", 6))


@query("f03_print_tolerance", "SELECT p_partkey, 0.5 * power(10.0, -(p_size % 5)) AS tolerance FROM part")
def f03(spark, sf):
    return table(spark, sf, "part").select("p_partkey", print_tolerance(F.col("p_size") % 5).alias("tolerance"))


def expectations(spark, sf):
    """The means as printed with one decimal; March is off, one status is not covered."""
    printed = F.round(F.coalesce("mean", F.lit(0.0)), 1) + F.when(F.col("month") == 3, 0.2).otherwise(0.0)
    # Twelve rows per station: the collected list has twelve members.
    return order_means(spark, sf).groupBy("o_orderstatus").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("month", printed.alias("v")))), lambda x: x["v"]).alias("monthly")
    ).select(
        "o_orderstatus", "monthly", (F.col("o_orderstatus") != "P").alias("covered"), F.lit(None).cast("string").alias("reason"),
        print_tolerance(F.lit(1)).alias("tolerance"),
    )


@query(
    "f04_check_means",
    MEANS + "SELECT o_orderstatus, month::INTEGER AS month, month <> 3 AND mean IS NOT NULL AS passed FROM m WHERE o_orderstatus <> 'P'",
)
def f04(spark, sf):
    checked = r.check_means(order_means(spark, sf), expectations(spark, sf), ["o_orderstatus"])
    return checked.select("o_orderstatus", "month", "passed")


@query(
    "f05_coverage",
    """SELECT DISTINCT o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 'uncovered' ELSE 'covered' END AS state,
              CASE o_orderstatus WHEN 'P' THEN 'the summary has no such section' END AS reason FROM orders""",
)
def f05(spark, sf):
    return r.coverage(expectations(spark, sf), ["o_orderstatus"]).select("o_orderstatus", "state", "reason")


RESERVED = [(6, 99.0, "missing"), (6, 77.0, "observation"), (7, 9.0, "missing"), (7, 1e9, "missing")]


@query(
    "f06_audit_reserved",
    """WITH e AS (SELECT event_id, event_type, json_extract(props, '$.k')::DOUBLE AS k, user_id FROM events)
       SELECT 6 AS position, 99.0::DOUBLE AS value, 'missing' AS kind, count(*) AS rows, 0::BIGINT AS misread, NULL::BIGINT AS first_misread FROM e WHERE k = 99
       UNION ALL SELECT 6, 77.0, 'observation', count(*), count(*) FILTER (event_type = 'error'), min(event_id) FILTER (event_type = 'error') + 1 FROM e WHERE k = 77
       UNION ALL SELECT 7, 9.0, 'missing', count(*), count(*) FILTER (event_type = 'click'), min(event_id) FILTER (event_type = 'click') + 1 FROM e WHERE user_id = 9""",
)
def f06(spark, sf):
    # The reader under audit blanks an observation in error events and keeps an absence in clicks.
    e = table(spark, sf, "events")
    k, user, kind = F.get_json_object("props", "$.k").cast("double"), F.col("user_id").cast("double"), F.col("event_type")

    def long(*values):
        cells = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), v.alias("value")) for p, v in values]))
        return e.select(F.col("event_id").alias("row"), cells.alias("c")).select("row", "c.*")

    raw = long((6, k), (7, user))
    read = long(
        (6, F.when(~((k == 99) | ((k == 77) & (kind == "error"))), k)), (7, F.when((user != 9) | (kind == "click"), user))
    )
    return r.audit_reserved(raw, read, [], RESERVED)


@query(
    "f07_unpaired_files",
    "SELECT 'o' || o_orderkey || '.epw.gz' AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def f07(spark, sf):
    named = lambda df, key, suffix: df.select(F.concat(F.lit("o"), F.col(key).cast("string"), F.lit(suffix)).alias("name"))
    files = named(table(spark, sf, "orders"), "o_orderkey", ".epw.gz").unionByName(
        named(table(spark, sf, "lineitem").select("l_orderkey").distinct(), "l_orderkey", ".stat.gz")
    )
    return r.unpaired(files, "name", ".epw.gz", ".stat.gz")


@query("f07_the_one_unpaired", "SELECT max(o_orderkey) || '.epw.gz' AS name FROM orders")
def f07_one(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    last = o.agg(F.max("o_orderkey").alias("o_orderkey"))
    named = lambda df, suffix: df.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(suffix)).alias("name"))
    files = named(o, ".epw.gz").unionByName(named(o.join(last, "o_orderkey", "left_anti"), ".stat.gz"))
    return r.exactly_one(r.unpaired(files, "name", ".epw.gz", ".stat.gz"))
