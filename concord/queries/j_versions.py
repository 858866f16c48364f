"""Versions and fleet currency: versions and requirements are made from part and order columns."""

from pyspark.sql import functions as F

from concord.functions.versions import level_of, normalize_version, version_key
from concord.operators import fleet as f
from concord.operators.skew import spread_join
from concord.queries.registry import query, table


def s(c):
    return F.col(c).cast("string")


# A version per part: size.key-mod-7.key-mod-12, a candidate for small parts.
VERSION = "p_size || '.' || p_partkey % 7 || '.' || p_partkey % 12 || CASE p_type WHEN 'SMALL' THEN '-rc.' || p_partkey % 5 WHEN 'PROMO' THEN 'rc' || p_partkey % 5 ELSE '' END"


def part_versions(spark, sf):
    p = table(spark, sf, "part")
    five = (F.col("p_partkey") % 5).cast("string")
    tail = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("-rc."), five)).when(F.col("p_type") == "PROMO", F.concat(F.lit("rc"), five)).otherwise("")
    version = F.concat(s("p_size"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"), tail)
    return p.select("p_partkey", "p_brand", "p_type", "p_size", "p_name", version.alias("version"))


NORMAL = f"replace({VERSION}, '-rc.', 'rc')"


@query("j01_normalize_version", f"SELECT p_partkey, {NORMAL} AS normal FROM part")
def j01(spark, sf):
    v = part_versions(spark, sf)
    dressed = F.concat(F.lit(" V"), F.upper("version"), F.lit(" "))
    return v.select("p_partkey", normalize_version(dressed).alias("normal"))


@query(
    "j02_requirement_level",
    f"""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN NULL WHEN 'STANDARD' THEN NULL ELSE {VERSION} END AS level FROM part""",
)
def j02(spark, sf):
    v, kind = F.col("version"), F.col("p_type")
    raw = (
        F.when(kind == "SMALL", F.concat(F.lit("Tool=="), v))
        .when(kind == "PROMO", F.concat(F.lit("tool[extra]@"), v))
        .when(kind == "ECONOMY", F.concat(F.lit("tool>="), v))
        .when(kind == "STANDARD", F.lit("tool"))
        .when(kind == "LARGE", F.concat(F.lit(" tool == "), v))
        .otherwise(v)
    )
    return part_versions(spark, sf).select("p_partkey", level_of(raw, F.lit("tool")).alias("level"))


ORDER = "p_size::BIGINT * 1000000000 + (p_partkey % 7) * 1000000 + (p_partkey % 12) * 1000 + CASE WHEN p_type IN ('SMALL', 'PROMO') THEN p_partkey % 5 ELSE 100 END"


@query("j03_version_order", f"SELECT p_partkey, ({ORDER}) > (30 * 1000000000::BIGINT + 3 * 1000000 + 5 * 1000 + 100) AS newer FROM part")
def j03(spark, sf):
    newer = version_key(F.col("version")) > version_key(F.lit("30.3.5"))
    return part_versions(spark, sf).select("p_partkey", newer.alias("newer"))


@query("j04_newest", f"SELECT p_brand, arg_max({NORMAL}, {ORDER}) AS newest FROM part GROUP BY 1")
def j04(spark, sf):
    return f.newest(part_versions(spark, sf), ["p_brand"], "version").select("p_brand", normalize_version(F.col("newest")).alias("newest"))


@query(
    "j05_effective_level",
    "SELECT o_orderkey, coalesce(min(l_partkey)::VARCHAR, o_orderpriority) AS effective FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey, o_orderpriority",
)
def j05(spark, sf):
    # The smallest part of an order's returns is its lock; the priority is what it declares.
    locks = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").cast("string").alias("locked"))
    declared = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("level"))
    return f.effective_level(declared, locks, ["o_orderkey"]).select("o_orderkey", "effective")


def observations(spark, sf):
    """Customers are consumers, segments libraries, orders declarations: status O is own, a low
    priority names no level, an urgent order of a household could not be read."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    rows = spread_join(o.withColumn("c_custkey", F.col("o_custkey")), c, ["c_custkey"], "inner")
    level = F.when(F.col("o_orderpriority") != "5-LOW", F.concat((F.col("o_orderkey") % 3).cast("string"), F.lit(".0")))
    return rows.select(
        F.col("c_custkey").alias("consumer"), F.col("c_mktsegment").alias("library"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "O").alias("own"),
        level.alias("level"), F.lit(None).cast("string").alias("locked"), level.alias("delivers"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("c_mktsegment") == "HOUSEHOLD"), "timeout").alias("error"),
        F.when(F.col("c_acctbal") < 0, "decided").alias("lag"),
    )


def standings(spark, sf):
    current = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("library")).distinct().withColumn("newest", F.lit("v2.0"))
    return f.judge(observations(spark, sf), current)


STANDINGS = """
WITH r AS (SELECT c_custkey, c_mktsegment, c_acctbal, o_orderkey, o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey % 3 || '.0' END AS level,
                  o_orderpriority = '1-URGENT' AND c_mktsegment = 'HOUSEHOLD' AS bad FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT c_custkey AS consumer, c_mktsegment AS library, any_value(c_acctbal) AS bal, bool_or(bad) AS bad, bool_or(o_orderstatus = 'O') AS own,
             arg_min(coalesce(level, '-'), o_orderkey) FILTER (o_orderstatus = 'O') AS lvl, bool_or(o_orderstatus <> 'O' AND level IS NULL) AS unpinned FROM r GROUP BY ALL),
st AS (SELECT consumer, library, CASE WHEN bal < 0 THEN 'decided' END AS lag,
              CASE WHEN bad THEN 'unread' WHEN own THEN CASE lvl WHEN '-' THEN 'unpinned' WHEN '2.0' THEN 'current' ELSE 'behind' END
                   WHEN unpinned THEN 'unpinned' ELSE 'via-provider' END AS standing FROM g)
"""


@query("j06_standing", STANDINGS + "SELECT consumer, library, standing FROM st")
def j06(spark, sf):
    return standings(spark, sf).select("consumer", "library", "standing")


@query(
    "j06_delivered_levels",
    STANDINGS + "SELECT DISTINCT consumer, library, level AS delivers FROM st JOIN r ON c_custkey = consumer AND c_mktsegment = library WHERE standing = 'via-provider' AND level IS NOT NULL",
)
def j06_delivered(spark, sf):
    return f.delivered_levels(observations(spark, sf), standings(spark, sf))


@query(
    "j07_unexplained",
    STANDINGS
    + """SELECT consumer, CASE WHEN lag IS NULL THEN 'unexplained' ELSE 'stale reason' END AS finding FROM st
         WHERE (standing IN ('behind', 'unpinned') AND lag IS NULL) OR (standing = 'current' AND lag IS NOT NULL)""",
)
def j07(spark, sf):
    return f.explain(standings(spark, sf)).select("consumer", "finding")


@query(
    "j08_scoped_level",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'nation_' || c_nationkey WHEN n_regionkey <> 2 THEN 'region_' || n_regionkey END AS scoped
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def j08(spark, sf):
    level = F.concat(F.lit("nation_"), s("c_nationkey"))
    df = table(spark, sf, "customer").select("c_custkey", level.alias("level"), (F.col("c_acctbal") < 0).alias("direct"))
    mapping = table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.concat(F.lit("nation_"), s("n_nationkey")).alias("version"), F.concat(F.lit("region_"), s("n_regionkey")).alias("delivers")
    )
    return f.scoped_level(df, "level", F.col("direct"), mapping).select("c_custkey", "scoped")


@query(
    "j09_disagreements",
    """WITH d AS (SELECT DISTINCT l_orderkey AS consumer, CASE WHEN l_returnflag IN ('R', 'A') THEN 'tool-release' ELSE l_returnflag END AS key, l_linestatus AS level FROM lineitem)
       SELECT consumer, key, lower(level) AS level FROM d WHERE (consumer, key) IN (SELECT (consumer, key) FROM d GROUP BY ALL HAVING count(*) > 1)""",
)
def j09(spark, sf):
    declared = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("consumer"), F.lit("tool").alias("library"), F.col("l_returnflag").alias("package"), F.col("l_linestatus").alias("level")
    )
    return f.disagreements(declared, {"tool": ["R", "A"]}).select("consumer", "key", "level")


@query(
    "j10_strangers",
    """WITH ord AS (SELECT DISTINCT 'c' || o_custkey AS repository, o_orderstatus AS path, o_orderpriority AS package FROM orders WHERE o_orderpriority <> '5-LOW'),
            bad AS (SELECT 'c' || c_custkey AS repository FROM customer WHERE c_acctbal < -900)
       SELECT repository, 'stranger' AS finding, path || ': ' || package AS declaration FROM ord
       WHERE repository NOT IN (SELECT repository FROM bad) AND repository NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
       UNION ALL SELECT repository, 'unread', NULL FROM bad WHERE repository NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))""",
)
def j10(spark, sf):
    c = table(spark, sf, "customer")
    found = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), s("o_custkey")).alias("repository"), F.col("o_orderstatus").alias("path"), F.col("o_orderpriority").alias("package")
    )
    roster = c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.concat(F.lit("C"), s("c_custkey")).alias("repository"))
    unread = c.where("c_acctbal < -900").select(F.concat(F.lit("c"), s("c_custkey")).alias("repository"))
    return f.strangers(found, roster, unread, ["5-LOW"])


@query(
    "j11_dependencies",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'dev' ELSE 'dependencies' END AS section, p_brand AS package, '^' || p_size AS requirement FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
       UNION ALL SELECT p_partkey, 'optional', 'Brand#3', '*' FROM part WHERE p_type = 'SMALL'""",
)
def j11(spark, sf):
    kind = F.col("p_type")
    mine = F.create_map("p_brand", F.concat(F.lit("^"), s("p_size")))
    doc = F.to_json(
        F.struct(
            F.when(kind != "PROMO", mine).alias("dependencies"), F.when(kind == "PROMO", mine).alias("devDependencies"),
            F.when(kind == "SMALL", F.create_map(F.lit("Brand#3"), F.lit("*"), F.lit("other"), F.lit("1"))).alias("optionalDependencies"), F.lit("x").alias("name"),
        )
    )
    wanted = spark.sql("SELECT * FROM VALUES ('Brand#1'), ('Brand#2'), ('Brand#3') AS t(package)")
    return f.dependencies(table(spark, sf, "part").select("p_partkey", doc.alias("doc")), ["p_partkey"], "doc", wanted)


@query(
    "j12_disabled_schedules",
    """SELECT user_id AS repository, event_id::VARCHAR AS name, 'disabled' AS finding FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE value > 150)
       UNION ALL SELECT DISTINCT user_id, NULL, 'unreadable' FROM events WHERE value > 150""",
)
def j12(spark, sf):
    e = table(spark, sf, "events")
    state = F.when(F.col("event_type") == "error", "disabled_inactivity").when(F.col("event_type") == "view", "disabled_manually").otherwise("active")
    schedules = e.select(F.col("user_id").alias("repository"), s("event_id").alias("name"), state.alias("state"))
    return f.disabled_schedules(schedules, e.where("value > 150").select(F.col("user_id").alias("repository")))


@query(
    "j13_waves",
    """WITH RECURSIVE w AS (SELECT p_partkey AS node, 1 AS wave FROM part WHERE p_partkey = 0
                            UNION ALL SELECT p.p_partkey, w.wave + 1 FROM part p JOIN w ON p.p_partkey // 10 = w.node WHERE p.p_partkey > 0)
       SELECT node, wave FROM w""",
)
def j13(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    edges = p.where("node > 0").select(F.col("node").alias("src"), F.floor(F.col("node") / 10).alias("dst"))
    # An edge to something that is no member does not count.
    outside = p.select(F.col("node").alias("src"), (-F.col("node") - 1).alias("dst"))
    return f.waves(p, edges.unionByName(outside))


@query(
    "j14_order_gate",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (o_orderstatus = 'F' AND l_linestatus = 'F' OR o_orderstatus = 'O' AND l_linestatus = 'O')",
)
def j14(spark, sf):
    asked = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("provider"), F.col("l_linestatus").alias("level"))
    held = table(spark, sf, "orders").select(F.col("o_orderkey").alias("provider"), F.col("o_orderstatus").alias("level"))
    return f.order_gate(asked, held).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "j15_qualify",
    """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'draft' WHEN p_type IN ('SMALL', 'PROMO') THEN 'tag is not exact' WHEN p_brand = 'Brand#2' THEN 'prerelease'
              WHEN p_size = 1 THEN 'no assets' END AS reason FROM part""",
)
def j15(spark, sf):
    reason = f.qualify(F.col("p_brand") == "Brand#1", F.concat(F.lit("v"), "version"), F.col("p_brand") == "Brand#2", F.col("p_size") - 1)
    return part_versions(spark, sf).select("p_partkey", reason.alias("reason"))


@query(
    "j16_awaiting",
    f"""WITH v AS (SELECT p_partkey, p_type, {VERSION} AS version, ({ORDER}) AS o FROM part)
        SELECT p_partkey, version FROM v WHERE o > 40 * 1000000000::BIGINT + 100 AND version NOT IN (SELECT version FROM v WHERE p_type = 'MEDIUM')""",
)
def j16(spark, sf):
    v = part_versions(spark, sf)
    return f.awaiting(v, "version", "40.0.0", v.where("p_type = 'MEDIUM'")).select("p_partkey", "version")


ASSETS = """
WITH a AS (SELECT p_brand, CASE WHEN p_type = 'PROMO' THEN 'tool-mac.zip' ELSE 'tool-Linux-Ubuntu' || p_size % 20 || '.04.tar.gz' END AS name,
                  CASE WHEN p_type = 'PROMO' THEN 'mac' ELSE 'linux' END AS role, p_size % 20 AS build FROM part WHERE p_type IN ('PROMO', 'SMALL'))
"""


def part_assets(spark, sf):
    p = table(spark, sf, "part").where("p_type IN ('PROMO', 'SMALL')")
    name = F.when(F.col("p_type") == "PROMO", "tool-mac.zip").otherwise(
        F.concat(F.lit("tool-Linux-Ubuntu"), (F.col("p_size") % 20).cast("string"), F.lit(".04.tar.gz"))
    )
    return p.select("p_brand", name.alias("name"))


ROLES = {"linux": "*-Linux-*.tar.gz", "mac": "*-mac.zip"}


@query(
    "j17_oldest_asset",
    ASSETS
    + """SELECT p_brand, role, CASE WHEN count(*) = 1 OR (role = 'linux' AND count(DISTINCT build) = count(*)) THEN arg_min(name, build) END AS asset,
              CASE WHEN NOT (count(*) = 1 OR (role = 'linux' AND count(DISTINCT build) = count(*))) THEN count(*) || ' assets fit' END AS problem FROM a GROUP BY p_brand, role""",
)
def j17(spark, sf):
    return f.pick_asset(part_assets(spark, sf), ["p_brand"], "name", ROLES)


@query(
    "j17_stated_asset",
    ASSETS
    + """SELECT p_brand, role, CASE WHEN count(*) FILTER (role = 'linux' AND build = 14) = 1 THEN 'tool-Linux-Ubuntu14.04.tar.gz' END AS asset,
              CASE WHEN count(*) FILTER (role = 'linux' AND build = 14) <> 1 THEN count(*) FILTER (role = 'linux' AND build = 14) || ' assets fit' END AS problem FROM a GROUP BY p_brand, role""",
)
def j17_stated(spark, sf):
    return f.pick_asset(part_assets(spark, sf), ["p_brand"], "name", ROLES, stated="14.04")


@query(
    "j18_source_drift",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'no longer published' ELSE 'changed' END AS change FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0""",
)
def j18(spark, sf):
    c = table(spark, sf, "customer")
    live = c.where("c_mktsegment <> 'BUILDING'").withColumn("c_acctbal", F.abs("c_acctbal"))
    return f.drift(c, live, ["c_custkey"], ["c_name", "c_acctbal"])


@query(
    "j19_standing_approval",
    """WITH v AS (SELECT user_id, json_extract(props, '$.k')::INTEGER % 5 AS who, event_id, event_type, value, ts FROM events WHERE event_type IN ('click', 'view', 'error')),
            l AS (SELECT user_id, who, arg_max(event_type, event_id) AS st, arg_max(value > 10, event_id) AS head, max(event_id) AS seen FROM v WHERE who <> 4 GROUP BY ALL),
            a AS (SELECT user_id, arg_max(who, seen) AS w, max(seen) AS seen FROM l WHERE st = 'click' AND head GROUP BY 1)
       SELECT user_id, 'p' || w AS "by", seen AS event_id FROM a""",
)
def j19(spark, sf):
    who = (F.get_json_object("props", "$.k").cast("int") % 5)
    login = F.when(who == 4, "ci[bot]").otherwise(F.concat(F.lit("p"), who.cast("string")))
    kind = F.col("event_type")
    state = F.when(kind == "click", "APPROVED").when(kind == "view", "CHANGES_REQUESTED").when(kind == "error", "DISMISSED").otherwise("COMMENTED")
    e = table(spark, sf, "events")
    reviews = e.select(
        "user_id", F.col("event_id").alias("ord"), login.alias("login"), state.alias("state"),
        F.when(F.col("value") > 10, "head").otherwise("old").alias("commit"), F.col("event_id").alias("at"),
    )
    heads = e.select("user_id").distinct().withColumn("head", F.lit("head"))
    return f.standing_approval(reviews, heads, "user_id").withColumnRenamed("at", "event_id")
