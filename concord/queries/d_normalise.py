"""Normalisation over the driver's tables."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import normalise as n
from concord.operators.changes import apply_changes
from concord.operators.skew import blocked_number
from concord.queries.registry import query, table
from concord.sources.statements import statements


@query(
    "d01_synthetic_key",
    "SELECT event_id, event_type || ' ' || row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS synthetic FROM events",
)
def d01(spark, sf):
    keyed = n.synthetic_key(table(spark, sf, "events"), [], "event_type", "event_id", rows=1000)
    return keyed.select("event_id", "synthetic")


@query(
    "d02_blank_name",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN value < 20 THEN '' ELSE 'e' || event_id END
              ELSE event_type || ' ' || row_number() OVER (PARTITION BY event_type ORDER BY event_id) END AS key FROM events""",
)
def d02(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "event_type", F.col("event_type").isin("click", "view").alias("has_name"),
        F.when(F.col("value") >= 20, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("name"),
    )
    return n.object_key(e, [], "event_type", "event_id", "has_name", "name", rows=1000).select("event_id", "key")


def part_slots(spark, sf):
    """Parts as positional slots: name (blank for PROMO), size (0 for SMALL), a blank tail."""
    p = table(spark, sf, "part")
    slots = F.array(
        F.when(F.col("p_type") == "PROMO", "  ").otherwise(F.col("p_name")),
        F.when(F.col("p_type") == "SMALL", "0").otherwise(F.col("p_size").cast("string")),
        F.when(F.col("p_type") == "LARGE", F.col("p_brand")).otherwise(F.lit("")),
    )
    return p.select("p_partkey", "p_type", F.posexplode(slots).alias("pos", "raw"))


@query(
    "d03_drop_unset",
    """SELECT p_partkey, 0 AS pos, p_name AS raw FROM part WHERE p_type <> 'PROMO'
       UNION ALL SELECT p_partkey, 1, CASE WHEN p_type = 'SMALL' THEN '0' ELSE p_size::VARCHAR END FROM part
       UNION ALL SELECT p_partkey, 2, p_brand FROM part WHERE p_type = 'LARGE'""",
)
def d03(spark, sf):
    return n.drop_unset(part_slots(spark, sf)).select("p_partkey", "pos", "raw")


FOLDED = """
WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
f AS (SELECT user_id, (pos - 2) // 3 AS grp, max(CASE WHEN (pos - 2) % 3 = 0 THEN event_type END) AS first_member,
             max(CASE WHEN (pos - 2) % 3 = 1 THEN event_type END) AS second_member, max(CASE WHEN (pos - 2) % 3 = 2 THEN event_type END) AS third_member
      FROM s WHERE pos >= 2 GROUP BY ALL)
"""


def user_slots(spark, sf):
    """The events of a user, in order, as the slots of one record."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return blocked_number(e, ["user_id"], "event_id", "_at", rows=1000).withColumn("pos", F.col("_at") - 1)


def user_groups(spark, sf):
    return n.fold_groups(user_slots(spark, sf), ["user_id"], "pos", "event_type", 2, ["first_member", "second_member", "third_member"])


@query("d04_fold_groups", FOLDED + "SELECT user_id, grp, first_member, second_member, third_member FROM f")
def d04(spark, sf):
    return user_groups(spark, sf).withColumnRenamed("group", "grp")


@query("d05_partial_group", FOLDED + "SELECT user_id, grp FROM f WHERE third_member IS NULL")
def d05(spark, sf):
    return user_groups(spark, sf).where("third_member IS NULL").select("user_id", F.col("group").alias("grp"))


@query(
    "d06_no_group",
    """SELECT c_custkey, count(o_orderkey) > 2 AS has_groups FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'
       GROUP BY c_custkey""",
)
def d06(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_orderpriority")
    slots = blocked_number(orders, ["o_custkey"], "o_orderkey", "_at", rows=1000).withColumn("pos", F.col("_at") - 1)
    groups = n.fold_groups(slots, ["o_custkey"], "pos", "o_orderpriority", 2, ["a", "b"])
    held = groups.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has_groups", F.lit(True))
    return table(spark, sf, "customer").join(held, "c_custkey", "left").select(
        "c_custkey", F.coalesce("has_groups", F.lit(False)).alias("has_groups")
    )


@query(
    "d07_wrapper_key",
    """SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'targets' WHEN 'view' THEN 'pages' WHEN 'error' THEN 'frames' END AS wrapper FROM events""",
)
def d07(spark, sf):
    known = spark.sql("SELECT * FROM VALUES ('click', 'targets'), ('view', 'pages'), ('error', 'frames') AS t(obj_type, ext_key)")
    return n.wrapper_keys(table(spark, sf, "events").select("event_id", "event_type"), known, "event_type")


NUMBER = r"'^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'"


@query(
    "d08_coerce",
    f"""WITH v AS (SELECT p_partkey, p_type, CASE p_type WHEN 'PROMO' THEN p_size || 'd' WHEN 'SMALL' THEN ' ' || p_size || '.0 ' WHEN 'LARGE' THEN p_size || 'e1'
                      WHEN 'ECONOMY' THEN 'Autosize' ELSE p_size::VARCHAR END AS t FROM part),
       w AS (SELECT *, p_type <> 'STANDARD' AND regexp_full_match(trim(t), {NUMBER}) AS ok FROM v)
       SELECT p_partkey, CASE WHEN ok AND p_type <> 'MEDIUM' THEN trim(t)::DOUBLE END AS num,
              CASE WHEN ok AND p_type = 'MEDIUM' THEN trim(t)::DOUBLE::BIGINT END AS whole, CASE WHEN NOT ok THEN t END AS str FROM w""",
)
def d08(spark, sf):
    kind, size = F.col("p_type"), F.col("p_size").cast("string")
    text = (
        F.when(kind == "PROMO", F.concat(size, F.lit("d")))
        .when(kind == "SMALL", F.concat(F.lit(" "), size, F.lit(".0 ")))
        .when(kind == "LARGE", F.concat(size, F.lit("e1")))
        .when(kind == "ECONOMY", "Autosize")
        .otherwise(size)
    )
    value = n.coerce(text, ~kind.isin("STANDARD", "MEDIUM"), kind == "MEDIUM")
    return table(spark, sf, "part").select("p_partkey", value.alias("v")).select(
        "p_partkey", "v.num", F.col("v.int").alias("whole"), "v.str"
    )


@query(
    "d09_union_slot",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS num, CASE WHEN event_type = 'view' THEN 'For: ' || event_type END AS str FROM events""",
)
def d09(spark, sf):
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("For: "), "event_type")).otherwise(F.col("value").cast("string"))
    value = n.coerce(text, F.lit(True), F.lit(False))
    return table(spark, sf, "events").select("event_id", value.alias("v")).select("event_id", "v.num", "v.str")


@query(
    "d10_sentinel",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Autocalculate' WHEN 'SMALL' THEN 'Autosize' WHEN 'LARGE' THEN 'Autocalculate' ELSE p_size::VARCHAR END AS canonical FROM part""",
)
def d10(spark, sf):
    # PROMO spells its keyword in capitals; LARGE writes the keyword its field does not know.
    kind = F.col("p_type")
    value = F.when(kind == "PROMO", "AUTOCALCULATE").when(kind == "SMALL", "autoSize").when(kind == "LARGE", "AutoSize").otherwise(F.col("p_size").cast("string"))
    known = spark.sql("SELECT * FROM VALUES ('PROMO', 'Autocalculate'), ('SMALL', 'Autosize'), ('LARGE', 'Autocalculate') AS t(p_type, spelling)")
    df = table(spark, sf, "part").select("p_partkey", "p_type", value.alias("value"))
    return n.canon_sentinel(df, known, ["p_type"], "value", "canonical").select("p_partkey", "canonical")


@query("d11_choice_casing", "SELECT c_custkey, c_mktsegment AS choice FROM customer")
def d11(spark, sf):
    customer = table(spark, sf, "customer")
    known = customer.select(F.col("c_mktsegment").alias("spelling")).distinct()
    written = F.when(F.col("c_acctbal") < 0, F.lower("c_mktsegment")).otherwise(F.initcap("c_mktsegment"))
    return n.canon_spelling(customer.select("c_custkey", written.alias("w")), known, [], "w", "choice").select("c_custkey", "choice")


@query(
    "d12_type_casing",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'ZONE:ERROR' ELSE 'Zone:' || upper(left(event_type, 1)) || substr(event_type, 2) END AS type_name FROM events""",
)
def d12(spark, sf):
    events = table(spark, sf, "events")
    known = events.select(F.concat(F.lit("Zone:"), F.initcap("event_type")).alias("spelling")).distinct().where("spelling <> 'Zone:Error'")
    written = events.select("event_id", F.upper(F.concat(F.lit("zone:"), "event_type")).alias("w"))
    return n.canon_spelling(written, known, [], "w", "type_name").select("event_id", "type_name")


@query(
    "d13_version_dictionary",
    """WITH v AS (SELECT p_partkey, (p_size % 4 + 7) || '.' || (p_partkey % 3) || CASE WHEN p_type = 'PROMO' THEN '' ELSE '.' || p_size % 2 END AS version FROM part)
       SELECT p_partkey, version, CASE WHEN version IN ('9.0.1', '9.1.0', '10.0.0', '8.2.0', '8.2.1') THEN version
              WHEN version IN ('9.1', '10.0') THEN version || '.0' WHEN version IN ('9.0', '9.0.0') THEN '9.0.1' WHEN version = '8.2' THEN '8.2.0'
              WHEN version = '9.1.1' THEN '9.1.0' WHEN version = '10.0.1' THEN '10.0.0' END AS dictionary FROM v""",
)
def d13(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    tail = F.when(F.col("p_type") == "PROMO", "").otherwise(F.concat(F.lit("."), (size % 2).cast("string")))
    version = F.concat((size % 4 + 7).cast("string"), F.lit("."), (key % 3).cast("string"), tail)
    known = spark.sql("SELECT * FROM VALUES ('9.0.1'), ('9.1.0'), ('10.0.0'), ('8.2.0'), ('8.2.1') AS t(version)")
    return n.resolve_version(table(spark, sf, "part").select("p_partkey", version.alias("version")), "version", known)


@query("d14_model_version", "SELECT doc_id, lang || '-' || source AS version FROM documents")
def d14(spark, sf):
    docs = table(spark, sf, "documents", spread=True)
    body = F.translate("text", ",;!", "   ")
    text = F.concat(F.lit("Note, "), body, F.lit(";\nVERSION,\n  "), "lang", F.lit("-"), "source", F.lit(";\nVersion, later;"))
    return n.model_version(statements(docs.select("doc_id", text.alias("content")), ["doc_id"]), ["doc_id"])


@query("d15_unknown_types", "SELECT event_id AS line, event_type AS obj_type FROM events WHERE event_type NOT IN ('click', 'view')")
def d15(spark, sf):
    known = spark.sql("SELECT * FROM VALUES ('Click'), ('VIEW') AS t(obj_type)")
    stated = table(spark, sf, "events").select(F.col("event_id").alias("line"), F.col("event_type").alias("obj_type"))
    return n.unknown_types(stated, known)


@query(
    "d15_first_unknown_type",
    """SELECT user_id, min(event_id) AS line, arg_min(event_type, event_id) AS obj_type FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1""",
)
def d15_first(spark, sf):
    known = spark.sql("SELECT * FROM VALUES ('Click'), ('VIEW') AS t(obj_type)")
    stated = table(spark, sf, "events").select("user_id", F.col("event_id").alias("line"), F.col("event_type").alias("obj_type"))
    return n.first_unknown_type(n.unknown_types(stated, known), ["user_id"], "line", "obj_type")


@query(
    "d16_collection_lookup",
    """SELECT q.query, true AS present, c_custkey, c_name FROM (VALUES ('machinery'), ('MACHINERY'), ('Building')) q(query) JOIN customer ON lower(q.query) = lower(c_mktsegment)
       UNION ALL SELECT 'Machinry', false, NULL, NULL""",
)
def d16(spark, sf):
    asked = spark.sql("SELECT * FROM VALUES ('machinery'), ('MACHINERY'), ('Building'), ('Machinry') AS t(query)")
    return n.lookup(table(spark, sf, "customer"), "c_mktsegment", "c_name", "c_custkey", asked)


@query(
    "d17_resolve_references",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'PART ' || l_partkey AS ref, CASE WHEN p_type <> 'PROMO' THEN 'Part ' || l_partkey END AS target
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def d17(spark, sf):
    refs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("PART "), F.col("l_partkey").cast("string")).alias("ref"))
    names = table(spark, sf, "part").where("p_type <> 'PROMO'").select(F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("name"))
    return n.resolve_refs(refs, "ref", names, "name")


@query(
    "d18_batch_patch",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN NULL ELSE c_name END AS c_name,
              CASE c_mktsegment WHEN 'BUILDING' THEN 2.5 WHEN 'HOUSEHOLD' THEN 7.0 ELSE c_acctbal END AS c_acctbal
       FROM customer WHERE c_mktsegment <> 'MACHINERY'
       UNION ALL SELECT -1 - s_suppkey, s_name, 0.5 FROM supplier""",
)
def d18(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    seg, key = F.col("c_mktsegment"), F.col("c_custkey")

    def op(df, seq, kind, field, value, key=key):
        return df.select(F.lit(seq).alias("seq"), F.lit(kind).alias("op"), key.alias("c_custkey"), F.lit(field).cast("string").alias("field"), F.lit(value).cast("string").alias("value") if not hasattr(value, "alias") else value.alias("value"))

    new = (-1 - F.col("s_suppkey"))
    ops = (
        op(c.where(seg == "BUILDING"), 1, "set-field", "c_acctbal", "1.5")
        .unionByName(op(c.where(seg == "BUILDING"), 2, "set-field", "c_acctbal", "2.5"))
        .unionByName(op(c.where(seg.isin("MACHINERY", "HOUSEHOLD")), 3, "remove", None, None))
        .unionByName(op(c.where(seg == "HOUSEHOLD"), 4, "add", "c_acctbal", "7.0"))
        .unionByName(op(s, 5, "add", "c_name", F.col("s_name"), new))
        .unionByName(op(s, 6, "set-field", "c_acctbal", "0.5", new))
    )
    return n.apply_patches(c, ops, "c_custkey", {"c_name": "string", "c_acctbal": "double"})


@query(
    "d18_rejects",
    """SELECT c_custkey, 1 AS seq, 'exists' AS reason FROM customer WHERE c_mktsegment = 'BUILDING'
       UNION ALL SELECT c_custkey, 3, 'no object' FROM customer WHERE c_mktsegment = 'MACHINERY'
       UNION ALL SELECT -1 - c_custkey, 4, 'no object' FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT c_custkey, 5, 'unreadable' FROM customer WHERE c_mktsegment = 'FURNITURE'""",
)
def d18_rejects(spark, sf):
    # Buildings are added though held; machinery is set after its removal; debtors' twins were never held; furniture gets words for a balance.
    c = table(spark, sf, "customer")
    op = lambda df, seq, kind, value, key="c_custkey": df.selectExpr(f"{seq} AS seq", f"'{kind}' AS op", f"{key} AS c_custkey", "'c_acctbal' AS field", f"'{value}' AS value")
    segment = lambda s: c.where(F.col("c_mktsegment") == s)
    ops = (
        op(segment("BUILDING"), 1, "add", "1.0").unionByName(op(segment("MACHINERY"), 2, "remove", "")).unionByName(op(segment("MACHINERY"), 3, "set-field", "2.0"))
        .unionByName(op(c.where("c_acctbal < 0"), 4, "set-field", "3.0", "-1 - c_custkey")).unionByName(op(segment("FURNITURE"), 5, "set-field", "a lot"))
    )
    return n.patch_rejects(c, ops, "c_custkey", {"c_name": "string", "c_acctbal": "double"}).select("c_custkey", "seq", "reason")


def threes(spark, sf):
    """Orders in documents of three, which have the same names in every document."""
    order = F.col("o_orderkey")
    names = F.concat(F.lit("Order "), (order % 3).cast("string"))
    return table(spark, sf, "orders").select(F.floor(order / 3).alias("doc"), (order % 3).alias("at"), names.alias("name"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))


def order_changes(spark, sf):
    """Open orders get an update with a field that is unknown, finished ones a good one; names move on when they are free."""
    o = threes(spark, sf)
    op = lambda at, where, seq, kind, name, field=None, value=None, to=None: o.where(F.col("at") == at).where(where).select(
        "doc", F.lit(seq).alias("seq"), F.lit(kind).alias("op"), F.lit(name).alias("name"), *[F.lit(v).cast("string").alias(c) for c, v in (("field", field), ("value", value), ("to", to))]
    )
    done, every = "status = 'F'", "true"
    changes = [
        op(0, "status IN ('F', 'O')", 1, "update", "ORDER 0", "total", "1.5"), op(0, done, 1, "update", "ORDER 0", "status", "X"),
        op(0, "status = 'O'", 1, "update", "ORDER 0", "colour", "red"), op(0, "status = 'P'", 1, "set-field", "order 0", "total", "a lot"),
        op(1, every, 2, "rename", "ORDER 1", to="Spare"), op(2, every, 3, "rename", "Order 0", to="ORDER 2"), op(2, done, 4, "remove", "order 2"),
        op(2, every, 5, "rename", "Spare", to="Order 2"), op(2, every, 6, "set-field", "order 2", "status", "last"),
        op(1, every, 7, "add", "order 1", "total", "7"), op(1, every, 8, "rename", "order 1", to="ORDER 1"),
    ]
    return apply_changes(o, functools.reduce(DataFrame.unionByName, changes), ["doc"], "name", {"total": "double", "status": "string"})


THREES = """WITH o AS (SELECT o_orderkey // 3 AS doc, o_orderkey % 3 AS nth, o_totalprice AS total, o_orderstatus AS status FROM orders),
    m AS (SELECT a.*, b.status AS next FROM o a LEFT JOIN o b ON b.doc = a.doc AND b.nth = 2) """


@query(
    "d18_changes",
    THREES
    + """SELECT doc, 'Order 0' AS name, CASE status WHEN 'F' THEN 1.5 ELSE total END AS total, CASE status WHEN 'F' THEN 'X' ELSE status END AS status FROM o WHERE nth = 0
       UNION ALL SELECT doc, CASE next WHEN 'F' THEN 'Order 2' ELSE 'Spare' END, total, CASE next WHEN 'F' THEN 'last' ELSE status END FROM m WHERE nth = 1
       UNION ALL SELECT doc, 'Order 2', total, 'last' FROM o WHERE nth = 2 AND status <> 'F'
       UNION ALL SELECT doc, 'ORDER 1', 7.0, NULL FROM o WHERE nth = 1""",
)
def d18_changes(spark, sf):
    return order_changes(spark, sf)[0]


@query(
    "d18_change_rejects",
    THREES
    + """SELECT doc, 1 AS seq, 'total' AS field, CASE status WHEN 'O' THEN 'group refused' ELSE 'unreadable' END AS reason FROM o WHERE nth = 0 AND status IN ('O', 'P')
       UNION ALL SELECT doc, 1, 'colour', 'unknown field' FROM o WHERE nth = 0 AND status = 'O'
       UNION ALL SELECT doc, 3, NULL, 'exists' FROM o WHERE nth = 2
       UNION ALL SELECT doc, 5, NULL, 'exists' FROM o WHERE nth = 2 AND status <> 'F'""",
)
def d18_change_rejects(spark, sf):
    return order_changes(spark, sf)[1].select("doc", "seq", "field", "reason")


@query(
    "d16_lookup_in_document",
    """WITH q AS (SELECT c_custkey AS o_custkey, lower(s) AS query FROM customer, (VALUES ('F'), ('p')) v(s))
       SELECT q.o_custkey, query, o_orderkey IS NOT NULL AS present, o_orderkey, o_orderpriority FROM q LEFT JOIN orders o ON o.o_custkey = q.o_custkey AND lower(o_orderstatus) = query""",
)
def d16_document(spark, sf):
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array(F.lit("f"), F.lit("p"))).alias("query"))
    return n.lookup(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey", asked, scope=["o_custkey"])


def nation_names(spark, sf):
    """Names that suppliers of several nations share, and customers who refer to them."""
    digit = lambda key, word: F.concat(F.lit(word), (F.col(key) % 10).cast("string"))
    names = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", digit("s_suppkey", "Source ").alias("name"))
    refs = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", digit("c_custkey", "SOURCE ").alias("ref"))
    return refs, names


@query(
    "d17_resolve_in_document",
    """SELECT c_custkey, c_nationkey AS nation, 'SOURCE ' || c_custkey % 10 AS ref,
              CASE WHEN (c_nationkey, c_custkey % 10) IN (SELECT (s_nationkey, s_suppkey % 10) FROM supplier) THEN 'Source ' || c_custkey % 10 END AS target FROM customer""",
)
def d17_document(spark, sf):
    refs, names = nation_names(spark, sf)
    return n.resolve_refs(refs, "ref", names, "name", scope=["nation"])


@query(
    "d19_rename_in_document",
    """SELECT c_custkey, c_nationkey AS nation, coalesce((SELECT min('first ' || s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 10 = c_custkey % 10),
              'SOURCE ' || c_custkey % 10) AS ref FROM customer""",
)
def d19_document(spark, sf):
    refs, names = nation_names(spark, sf)
    renames = names.select("nation", F.col("name").alias("old"), F.concat(F.lit("first "), F.col("s_suppkey").cast("string")).alias("new"))
    return n.rename_refs(refs, "ref", renames, ["nation"])


@query(
    "d19_rename",
    """SELECT l_orderkey, l_linenumber, CASE WHEN p_type = 'LARGE' THEN 'renamed ' || l_partkey ELSE 'PART ' || l_partkey END AS ref
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def d19(spark, sf):
    refs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("PART "), F.col("l_partkey").cast("string")).alias("ref"))
    key = F.col("p_partkey").cast("string")
    renames = table(spark, sf, "part").where("p_type = 'LARGE'").select(
        F.concat(F.lit("Part "), key).alias("old"), F.concat(F.lit("renamed "), key).alias("new")
    )
    return n.rename_refs(refs, "ref", renames)


def update_ops(spark, sf):
    """One group per customer: two plain fields, then a list member, one of them bad for some."""
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    entries = F.array(
        F.struct(F.lit("acctbal").alias("field"), F.lit(None).cast("string").alias("member"), F.lit("1").alias("value")),
        F.struct(
            F.when(seg == "BUILDING", "nam").when(seg == "FURNITURE", "name").otherwise("segment").alias("field"),
            F.lit(None).cast("string").alias("member"),
            F.lit("x").alias("value"),
        ),
        F.struct(F.lit("lines").alias("field"), F.when(seg == "MACHINERY", "quantty").otherwise("quantity").alias("member"), F.lit("2").alias("value")),
    )
    ops = c.select("c_custkey", F.explode(entries).alias("e")).select("c_custkey", "e.*")
    known = spark.sql(
        """SELECT * FROM VALUES ('acctbal', CAST(NULL AS STRING), false), ('segment', NULL, false), ('name', NULL, true), ('lines', 'quantity', false)
           AS t(field, member, is_name)"""
    )
    return n.judge_updates(ops, known, "c_custkey")


@query(
    "d20_atomic_update",
    """SELECT c_custkey, unnest(['acctbal', 'segment', 'lines']) AS field, unnest(['1', 'x', '2']) AS value FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD')""",
)
def d20(spark, sf):
    return update_ops(spark, sf)[0].select("c_custkey", "field", "value")


@query(
    "d20_refused_entries",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'nam' WHEN 'FURNITURE' THEN 'name' ELSE 'lines' END AS field,
              CASE c_mktsegment WHEN 'FURNITURE' THEN 'name field' ELSE 'unknown' END AS reason
       FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY')""",
)
def d20_refused(spark, sf):
    return update_ops(spark, sf)[1].select("c_custkey", "field", "reason")
