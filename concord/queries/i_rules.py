"""Record-table rules over the driver's tables."""

from pyspark.sql import functions as F

from concord.operators import rules as r
from concord.queries.registry import query, table


@query("i01_unique_key", "SELECT 'unique' AS rule, l_orderkey::VARCHAR AS key, 'met ' || count(*) || ' times' AS message FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def i01(spark, sf):
    return r.unique(table(spark, sf, "lineitem"), "l_orderkey")


@query("i02_domain", "SELECT 'domain' AS rule, o_orderkey::VARCHAR AS key, 'o_orderstatus is P' AS message FROM orders WHERE o_orderstatus = 'P'")
def i02(spark, sf):
    return r.in_set(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", ["O", "F"])


@query(
    "i03_conditional",
    """SELECT 'required' AS rule, o_orderkey::VARCHAR AS key, 'clerk is required' AS message FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'
       UNION ALL SELECT 'forbidden', o_orderkey::VARCHAR, 'clerk is forbidden' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'""",
)
def i03(spark, sf):
    o = table(spark, sf, "orders").withColumn("clerk", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise(" "))
    return r.required_if(o, "o_orderkey", "clerk", F.col("o_orderstatus") == "F").unionByName(
        r.forbidden_if(o, "o_orderkey", "clerk", F.col("o_orderstatus") == "O")
    )


@query("i04_exactly_one", "SELECT 'exactly-one' AS rule, doc_id::VARCHAR AS key, (quality + toxic) || ' hold' AS message FROM labels WHERE quality + toxic <> 1")
def i04(spark, sf):
    return r.exactly_one(table(spark, sf, "labels"), "doc_id", [F.col("quality") == 1, F.col("toxic") == 1])


@query("i05_shape", r"SELECT 'shape' AS rule, page_id::VARCHAR AS key, 'url has another shape' AS message FROM pages WHERE NOT regexp_matches(url, '^https://[^/\s]+/[a-z]{2}/\d+')")
def i05(spark, sf):
    return r.matches(table(spark, sf, "pages"), "page_id", "url", r"^https://[^/\s]+/[a-z]{2}/\d+")


@query("i06_foreign_key", "SELECT 'foreign-key' AS rule, l_orderkey::VARCHAR AS key, 'l_partkey names ' || l_partkey AS message FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO'")
def i06(spark, sf):
    return r.foreign_key(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", table(spark, sf, "part").where("p_type <> 'PROMO'"), "p_partkey")


@query(
    "i06_foreign_key_array",
    """SELECT 'foreign-key' AS rule, event_id::VARCHAR AS key, 'users names ' || (user_id + 100) AS message FROM events WHERE user_id + 100 NOT IN (SELECT c_custkey FROM customer)
       UNION ALL SELECT 'foreign-key', event_id::VARCHAR, 'users names ' || user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
       UNION ALL SELECT 'foreign-key', event_id::VARCHAR, 'users names -1' FROM events WHERE event_type = 'error'""",
)
def i06_array(spark, sf):
    third = F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.col("user_id"))
    e = table(spark, sf, "events").select("event_id", F.array_distinct(F.array("user_id", F.col("user_id") + 100, third)).alias("users"))
    return r.foreign_key(e, "event_id", "users", table(spark, sf, "customer"), "c_custkey")


@query("i07_must_not_match", r"SELECT 'must-not-match' AS rule, doc_id::VARCHAR AS key, 'text holds what it must not' AS message FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AND doc_id NOT IN (1, 2, 3)")
def i07(spark, sf):
    return r.must_not_match(table(spark, sf, "documents"), "doc_id", "text", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", ["1", "2", "3"])


@query(
    "i08_agree",
    """WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
       SELECT 'agree' AS rule, o_custkey::VARCHAR AS key, 'states o_orderpriority ' || o_orderpriority AS message FROM s
       WHERE o_custkey IN (SELECT o_custkey FROM s GROUP BY 1 HAVING count(*) > 1)""",
)
def i08(spark, sf):
    return r.agree(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query(
    "i09_coverage",
    """SELECT 'covers' AS rule, n AS key, 'missing' AS message FROM (SELECT 'Brand#' || (n_nationkey + 10) AS n FROM nation) WHERE n NOT IN (SELECT p_brand FROM part)
       UNION ALL SELECT DISTINCT 'covers', p_brand, 'unexpected' FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || (n_nationkey + 10) FROM nation)""",
)
def i09(spark, sf):
    expected = table(spark, sf, "nation").select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 10).cast("string")).alias("n"))
    return r.covers(table(spark, sf, "part"), "p_brand", expected, "n")


def part_edges(spark, sf):
    """A tree of part keys, with loops of three among sizes 50 and self loops among sizes 1."""
    p = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    tree = p.where(key > 0).select(key.alias("src"), F.floor(key / 10).alias("dst"))
    own = p.where(size == 1).select(key.alias("src"), key.alias("dst"))
    base = -(key * 3) - 1
    loops = p.where(size == 50).select(
        F.explode(
            F.array(
                F.struct(base.alias("src"), (base - 1).alias("dst")),
                F.struct((base - 1).alias("src"), (base - 2).alias("dst")),
                F.struct((base - 2).alias("src"), base.alias("dst")),
                F.struct(base.alias("src"), key.alias("dst")),
                F.struct(key.alias("src"), F.lit(-10**12).alias("dst")),
                F.struct(F.lit(-10**12).alias("src"), F.lit(-10**12 - 1).alias("dst")),
                F.struct(F.lit(-10**12 - 1).alias("src"), F.lit(-10**12).alias("dst")),
            )
        ).alias("e")
    ).select("e.*")
    return tree.unionByName(own).unionByName(loops)


@query(
    "i10_cycles",
    """WITH RECURSIVE loops AS (SELECT -(p_partkey * 3) - 1 AS b FROM part WHERE p_size = 50),
       edges AS (SELECT p_partkey AS src, p_partkey // 10 AS dst FROM part WHERE p_partkey > 0
                 UNION SELECT p_partkey, p_partkey FROM part WHERE p_size = 1
                 UNION SELECT b, b - 1 FROM loops UNION SELECT b - 1, b - 2 FROM loops UNION SELECT b - 2, b FROM loops
                 UNION SELECT -(p_partkey * 3) - 1, p_partkey FROM part WHERE p_size = 50
                 UNION SELECT p_partkey, -1000000000000 FROM part WHERE p_size = 50
                 UNION SELECT -1000000000000, -1000000000001 WHERE EXISTS (SELECT 1 FROM loops)
                 UNION SELECT -1000000000001, -1000000000000 WHERE EXISTS (SELECT 1 FROM loops)),
       reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)
       SELECT 'acyclic' AS rule, src::VARCHAR AS key, 'lies on a cycle' AS message FROM reach WHERE src = dst""",
)
def i10(spark, sf):
    return r.cycle_findings(part_edges(spark, sf))


@query(
    "i11_summary",
    """SELECT 'domain' AS rule, count(*) AS findings FROM orders WHERE o_orderstatus = 'P'
       UNION ALL SELECT 'foreign-key', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO'
       UNION ALL SELECT 'exactly-one', count(*) FROM labels WHERE quality + toxic <> 1""",
)
def i11(spark, sf):
    return r.summarise(i02(spark, sf).unionByName(i06(spark, sf)).unionByName(i04(spark, sf)))
