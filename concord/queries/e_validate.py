"""Validation of parts and line items against a small dictionary."""

from pyspark.sql import functions as F

from concord.operators import validate as v
from concord.queries.registry import query, table


def text_value(name, column):
    return F.struct(F.lit(name).alias("field"), F.when(column.isNull(), "null").otherwise("string").alias("jtype"),
                    F.lit(None).cast("double").alias("num"), column.alias("str"))


def number_value(name, column):
    return F.struct(F.lit(name).alias("field"), F.when(column.isNull(), "null").otherwise("number").alias("jtype"),
                    column.cast("double").alias("num"), F.lit(None).cast("string").alias("str"))


def part_values(spark, sf):
    """Values of parts, broken by part type: see the SQL of each query for what is broken where."""
    p = table(spark, sf, "part", spread=True)
    kind, size, price = F.col("p_type"), F.col("p_size"), F.col("p_retailprice")
    values = F.array(
        text_value("name", F.when(kind == "PROMO", " ").otherwise(F.col("p_name"))),
        F.when(kind == "SMALL", text_value("size", size.cast("string"))).otherwise(number_value("size", F.when(kind == "LARGE", size + 0.5).otherwise(size))),
        number_value("price", F.when(kind == "ECONOMY", -price).otherwise(price)),
        text_value("kind", F.when(kind == "MEDIUM", "Middling").otherwise(F.lower(kind))),
        F.when(kind == "PROMO", text_value("height", F.lit("autocalculate")))
        .when(kind == "SMALL", text_value("height", F.lit("Bogus")))
        .when(kind == "ECONOMY", F.struct(F.lit("height").alias("field"), F.lit("boolean").alias("jtype"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("str")))
        .otherwise(number_value("height", size)),
    )
    return p.select(F.lit("Part").alias("object_type"), F.col("p_partkey").cast("string").alias("object_name"), F.explode(values).alias("c")).select(
        "object_type", "object_name", "c.*"
    )


DICTIONARY = f"""
SELECT obj_type, field, pos, required, from_json(branches, '{v.BRANCHES}') AS branches,
       CAST(array() AS ARRAY<STRING>) AS object_list, CAST(array() AS ARRAY<STRING>) AS reference
FROM VALUES
 ('Part', 'name', 0, true, '[{{"type":"string"}}]'),
 ('Part', 'size', 1, true, '[{{"type":"integer","max":49,"xmin":1}}]'),
 ('Part', 'price', 2, false, '[{{"type":"number","min":0}}]'),
 ('Part', 'kind', 3, true, '[{{"type":"string","enum":["PROMO","SMALL","LARGE","ECONOMY","STANDARD","MEDIUM"]}}]'),
 ('Part', 'height', 4, false, '[{{"type":"number","xmax":50,"min":3}},{{"type":"string","enum":["","Autocalculate"]}}]')
 AS t(obj_type, field, pos, required, branches)
"""

CODES = """
WITH findings AS (
  SELECT p_partkey, 'size' AS field, 'E003' AS code FROM part WHERE p_type IN ('SMALL', 'LARGE')
  UNION ALL SELECT p_partkey, 'size', 'E006' FROM part WHERE p_type NOT IN ('SMALL', 'LARGE') AND p_size <= 1
  UNION ALL SELECT p_partkey, 'size', 'E007' FROM part WHERE p_type NOT IN ('SMALL', 'LARGE') AND p_size > 49
  UNION ALL SELECT p_partkey, 'price', 'E005' FROM part WHERE p_type = 'ECONOMY'
  UNION ALL SELECT p_partkey, 'kind', 'E004' FROM part WHERE p_type = 'MEDIUM'
  UNION ALL SELECT p_partkey, 'height', 'E004' FROM part WHERE p_type = 'SMALL'
  UNION ALL SELECT p_partkey, 'height', 'E002' FROM part WHERE p_type = 'ECONOMY'
  UNION ALL SELECT p_partkey, 'height', 'E005' FROM part WHERE p_type IN ('LARGE', 'STANDARD', 'MEDIUM') AND p_size < 3
  UNION ALL SELECT p_partkey, 'height', 'E008' FROM part WHERE p_type IN ('LARGE', 'STANDARD', 'MEDIUM') AND p_size >= 50)
"""


def codes(spark, sf, *wanted):
    found = v.check_values(part_values(spark, sf), spark.sql(DICTIONARY)).where(F.col("code").isin(*wanted))
    return found.select(F.col("object_name").cast("long").alias("p_partkey"), "field", "code")


def part_objects(spark, sf):
    return table(spark, sf, "part", spread=True).select(F.lit("Part").alias("object_type"), F.col("p_partkey").cast("string").alias("object_name"))


@query("e01_required", "SELECT p_partkey, 'name' AS field FROM part WHERE p_type = 'PROMO'")
def e01(spark, sf):
    found = v.check_required(part_objects(spark, sf), part_values(spark, sf), spark.sql(DICTIONARY))
    return found.select(F.col("object_name").cast("long").alias("p_partkey"), "field")


@query("e02_type", CODES + "SELECT * FROM findings WHERE code = 'E003'")
def e02(spark, sf):
    return codes(spark, sf, "E003")


@query("e03_enum", CODES + "SELECT * FROM findings WHERE code = 'E004'")
def e03(spark, sf):
    return codes(spark, sf, "E004")


@query("e04_bounds", CODES + "SELECT * FROM findings WHERE code IN ('E005', 'E006', 'E007', 'E008')")
def e04(spark, sf):
    return codes(spark, sf, "E005", "E006", "E007", "E008")


@query(
    "e04_two_dialects",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
              CASE WHEN l_returnflag = 'R' AND l_discount <= 0.02 THEN 'E006' WHEN l_returnflag = 'A' AND l_discount < 0.02 THEN 'E005'
                   WHEN l_returnflag = 'N' AND l_discount <= 0.03 THEN 'E006' END AS code FROM lineitem""",
)
def e04_dialects(spark, sf):
    # R: boolean true beside a minimum; A: boolean false; N: the exclusive bound itself.
    flag = F.col("l_returnflag")
    low, xlow = v.bounds(
        F.when(flag != "N", F.lit(0.02)), F.when(flag == "R", "true").when(flag == "A", "false").otherwise("0.03")
    )
    null = F.lit(None).cast("double")
    branch = F.struct(
        F.lit("number").alias("type"), F.lit(None).cast("array<string>").alias("enum"), low.alias("min"), null.alias("max"), xlow.alias("xmin"), null.alias("xmax")
    )
    code = v.value_code(F.array(branch), F.lit("number"), F.col("l_discount"), F.lit(None).cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", code.alias("code"))


@query("e05_any_of", CODES + "SELECT * FROM findings WHERE field = 'height'")
def e05(spark, sf):
    return codes(spark, sf, "E002", "E004", "E005", "E006", "E007", "E008").where("field = 'height'")


REFERENCES = """
SELECT obj_type, field, CAST(array() AS ARRAY<INT>) AS branches, object_list, reference FROM VALUES
 ('Order', 'key', CAST(array() AS ARRAY<STRING>), array('Orders')),
 ('Line', 'order', array('Orders'), array()),
 ('Line', 'part', array('Parts', 'Orders'), array()),
 ('Line', 'kind', array('TypeNames'), array()),
 ('Part', 'code', array(), array('Parts'))
 AS t(obj_type, field, object_list, reference)
"""


def reference_values(spark, sf):
    """Line items point at orders (open ones are not declared) and parts (PROMO ones are not)."""
    def rows(df, kind, name, cells):
        picked = F.explode(F.array(*[text_value(f, c) for f, c in cells.items()]))
        return df.select(F.lit(kind).alias("object_type"), name.alias("object_name"), picked.alias("c")).select("object_type", "object_name", "c.*")

    o = table(spark, sf, "orders").where("o_orderstatus <> 'O'")
    p = table(spark, sf, "part").where("p_type <> 'PROMO'")
    line = table(spark, sf, "lineitem", spread=True)
    order = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    part = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return (
        rows(o, "Order", order, {"key": order})
        .unionByName(rows(p, "Part", part, {"code": part}))
        .unionByName(
            rows(
                line,
                "Line",
                name,
                {
                    "order": F.concat(F.lit("o"), F.col("l_orderkey").cast("string")),
                    "part": F.concat(F.lit("p"), F.col("l_partkey").cast("string")),
                    "kind": F.col("l_returnflag"),
                },
            )
        )
    )


@query(
    "e06_dangling_reference",
    """WITH l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS object_name, o_orderstatus, p_type
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
       SELECT object_name, 'order' AS field, 'E009' AS code FROM l WHERE o_orderstatus = 'O'
       UNION ALL SELECT object_name, 'part', 'E009' FROM l WHERE p_type = 'PROMO'""",
)
def e06(spark, sf):
    return v.check_references(reference_values(spark, sf), spark.sql(REFERENCES)).select("object_name", "field", "code")


@query(
    "e07_reference_in_group",
    """SELECT l_orderkey::VARCHAR AS object_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO' GROUP BY 1""",
)
def e07(spark, sf):
    # Each order is a list of parts: one value per element of the repeated group.
    line = table(spark, sf, "lineitem")
    elements = line.select(
        F.lit("Line").alias("object_type"), F.col("l_orderkey").cast("string").alias("object_name"),
        text_value("part", F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("c"),
    ).select("object_type", "object_name", "c.*")
    names = v.reference_names(reference_values(spark, sf).where("object_type <> 'Line'"), spark.sql(REFERENCES))
    found = v.check_references(elements, spark.sql(REFERENCES), names)
    return found.groupBy("object_name").agg(F.count(F.lit(1)).alias("n"))


@query("e08_exempt_list", "SELECT 'Line' AS object_type, 'kind' AS field, count(*) AS pointers, 0::BIGINT AS findings FROM lineitem")
def e08(spark, sf):
    values = reference_values(spark, sf).where("field = 'kind'")
    names = v.reference_names(reference_values(spark, sf).where("object_type <> 'Line'"), spark.sql(REFERENCES))
    found = v.check_references(values, spark.sql(REFERENCES), names).groupBy("object_type", "field").agg(F.count(F.lit(1)).alias("n"))
    counted = values.groupBy("object_type", "field").agg(F.count(F.lit(1)).alias("pointers"))
    return counted.join(found, ["object_type", "field"], "left").select("object_type", "field", "pointers", F.coalesce("n", F.lit(0)).alias("findings"))


@query("e09_singleton", "SELECT user_id, event_type AS object_type, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY ALL HAVING count(*) > 1")
def e09(spark, sf):
    single = spark.sql("SELECT * FROM VALUES ('signup'), ('purchase') AS t(obj_type)")
    objects = table(spark, sf, "events").select("user_id", F.col("event_type").alias("object_type"))
    return v.check_singleton(objects, ["user_id"], single)


EVENT_DICTIONARY = """SELECT obj_type, field FROM VALUES ('click', 'k'), ('view', 'k'), ('view', 'value'), ('error', 'value') AS t(obj_type, field)"""


def event_objects(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("object_type"), F.col("event_id").cast("string").alias("object_name"))


def event_values(spark, sf):
    e = table(spark, sf, "events")
    cells = F.array(text_value("k", F.get_json_object("props", "$.k")), number_value("value", F.col("value")))
    return e.select(F.col("event_type").alias("object_type"), F.col("event_id").cast("string").alias("object_name"), F.explode(cells).alias("c")).select(
        "object_type", "object_name", "c.*"
    )


@query(
    "e10_unknown",
    """SELECT event_type AS object_type, event_id::VARCHAR AS object_name, NULL AS field, 'W002' AS code FROM events WHERE event_type IN ('signup', 'purchase')
       UNION ALL SELECT event_type, event_id::VARCHAR, 'value', 'W003' FROM events WHERE event_type = 'click'
       UNION ALL SELECT event_type, event_id::VARCHAR, 'k', 'W003' FROM events WHERE event_type = 'error'""",
)
def e10(spark, sf):
    found = v.check_unknown(event_objects(spark, sf), event_values(spark, sf), spark.sql(EVENT_DICTIONARY))
    return found.select("object_type", "object_name", "field", "code")


@query(
    "e11_finding_set",
    CODES
    + """, everything AS (SELECT p_partkey::VARCHAR AS object_name, field, code FROM findings UNION ALL SELECT p_partkey::VARCHAR, 'name', 'E001' FROM part WHERE p_type = 'PROMO'),
       expected AS (SELECT * FROM everything WHERE code <> 'E006' UNION ALL SELECT p_partkey::VARCHAR, 'name', 'E001' FROM part WHERE p_type = 'PROMO')
       SELECT side, object_name, field, code, n::BIGINT AS n FROM (
         SELECT 'left' AS side, object_name, field, code, count(*) AS n FROM everything WHERE code = 'E006' GROUP BY ALL
         UNION ALL SELECT 'right', object_name, field, code, count(*) FROM everything WHERE code = 'E001' GROUP BY ALL)""",
)
def e11(spark, sf):
    values, known = part_values(spark, sf), spark.sql(DICTIONARY)
    found = v.check_values(values, known).unionByName(v.check_required(part_objects(spark, sf), values, known))
    # Expected: everything but E006, and each E001 once more.
    expected = found.where("code <> 'E006'").unionByName(found.where("code = 'E001'"))
    return v.compare_findings(found, expected).select("side", "object_name", "field", "code", "n")


@query(
    "e12_describe",
    """SELECT p_type AS obj_type, 3::BIGINT AS fields, 'name:string,size:integer|number,brand:string' AS described, 'name,brand' AS required FROM part GROUP BY 1""",
)
def e12(spark, sf):
    types = table(spark, sf, "part").select(F.col("p_type").alias("obj_type")).distinct()
    field = lambda name, pos, required, kinds: F.struct(
        F.lit(name).alias("field"), F.lit(pos).alias("pos"), F.lit(required).alias("required"),
        F.from_json(F.lit("[" + ",".join('{"type":"%s"}' % k for k in kinds) + "]"), v.BRANCHES).alias("branches"),
    )
    known = types.select("obj_type", F.explode(F.array(
        field("brand", 2, True, ["string"]), field("size", 1, False, ["integer", "number"]), field("name", 0, True, ["string"])
    )).alias("f")).select("obj_type", "f.*")
    return v.describe(known, types)


@query(
    "e13_dictionary_diff",
    """WITH a AS (SELECT DISTINCT p_brand AS t, p_type AS f FROM part WHERE p_size <= 40 AND p_brand <> 'Brand#3'),
            b AS (SELECT DISTINCT p_brand AS t, p_type AS f FROM part WHERE p_size >= 10 AND p_brand <> 'Brand#5')
       SELECT t AS obj_type, NULL AS field, 'type added' AS change FROM (SELECT t FROM b EXCEPT SELECT t FROM a)
       UNION ALL SELECT t, NULL, 'type removed' FROM (SELECT t FROM a EXCEPT SELECT t FROM b)
       UNION ALL SELECT t, f, 'field added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) WHERE t IN (SELECT t FROM a)
       UNION ALL SELECT t, f, 'field removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) WHERE t IN (SELECT t FROM b)""",
)
def e13(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("obj_type"), F.col("p_type").alias("field"), "p_size")
    return v.diff_dictionaries(p.where("p_size <= 40 AND obj_type <> 'Brand#3'"), p.where("p_size >= 10 AND obj_type <> 'Brand#5'"))


@query(
    "e14_clean_renames",
    """SELECT old, new FROM (SELECT trim(CASE c_mktsegment WHEN 'BUILDING' THEN '!' || c_name WHEN 'FURNITURE' THEN c_custkey::VARCHAR ELSE ' ' || c_name END) AS old,
                                     trim(CASE WHEN c_acctbal < 0 THEN c_name WHEN c_acctbal < 1000 THEN ' ' ELSE lower(c_name) END) AS new, c_mktsegment FROM customer)
       WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE') AND new <> '' AND old <> new""",
)
def e14(spark, sf):
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    old = F.when(seg == "BUILDING", F.concat(F.lit("!"), name)).when(seg == "FURNITURE", F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit(" "), name))
    new = F.when(F.col("c_acctbal") < 0, name).when(F.col("c_acctbal") < 1000, " ").otherwise(F.lower(name))
    return v.clean_renames(table(spark, sf, "customer").select(old.alias("old"), new.alias("new")), "old", "new")


@query(
    "e15_required_by_model",
    """SELECT c_nationkey AS model, c_mktsegment AS object_name, 'name' AS field, 'E001' AS code FROM customer GROUP BY 1, 2 HAVING max(c_acctbal) <= 9000""",
)
def e15(spark, sf):
    # Nations are models that share object names; a segment is named in a nation if a rich customer of it lives there.
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("model"), F.lit("Segment").alias("object_type"), F.col("c_mktsegment").alias("object_name"), "c_name", "c_acctbal")
    values = c.where("c_acctbal > 9000").select("model", "object_type", "object_name", text_value("name", F.col("c_name")).alias("c")).select("model", "object_type", "object_name", "c.*")
    known = spark.sql("SELECT 'Segment' AS obj_type, 'name' AS field, true AS required")
    return v.check_required(c.select("model", "object_type", "object_name").distinct(), values, known, ["model"]).select("model", "object_name", "field", "code")


@query(
    "e16_dangling_by_model",
    """SELECT o_orderpriority AS model, o_orderkey::VARCHAR AS object_name, 'E009' AS code FROM orders o
       WHERE NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_orderstatus = 'F' AND f.o_custkey = o.o_custkey AND f.o_orderpriority = o.o_orderpriority)""",
)
def e16(spark, sf):
    # Priorities are models; a customer is declared in one by a finished order there, and pointed at by every order.
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").cast("string").alias("object_name"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("who"), "o_orderstatus")
    cells = lambda kind, field: [F.lit(kind).alias("object_type"), "model", "object_name", text_value(field, F.col("who")).alias("c")]
    values = o.where("o_orderstatus = 'F'").select(*cells("Order", "key")).unionByName(o.select(*cells("Line", "order"))).select("object_type", "model", "object_name", "c.*")
    return v.check_references(values, spark.sql(REFERENCES), model=["model"]).select("model", "object_name", "code")
