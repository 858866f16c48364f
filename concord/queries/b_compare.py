"""Typed comparison over the driver's tables.

Both sides of a comparison are the same table with changes chosen by its own attributes, so the
query and its SQL build the same pair and every row takes part.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from concord.functions.json import json_type
from concord.functions.numbers import num_equal
from concord.operators import compare
from concord.operators.drift import drift_window, line_col, text_drift
from concord.operators.nodes import json_nodes
from concord.operators.skew import blocked_number
from concord.queries.registry import query, table

COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def order_sides(spark, sf):
    """Orders under test and orders expected."""
    o = table(spark, sf, "orders").select("o_orderkey", *COLS)
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    left = o.where(~((status == "O") & (priority == "5-LOW"))).select(
        "o_orderkey",
        "o_custkey",
        F.when(~((status == "P") & (priority == "4-NOT SPECIFIED")), status).alias("o_orderstatus"),
        F.when(priority == "2-HIGH", F.col("o_totalprice") * (1 + 1e-13))
        .when((priority == "3-MEDIUM") & (status == "F"), F.col("o_totalprice") + 0.5)
        .otherwise(F.col("o_totalprice"))
        .alias("o_totalprice"),
        F.when(priority == "1-URGENT", F.lower(priority)).otherwise(priority).alias("o_orderpriority"),
    )
    right = o.where(~((status == "P") & (priority == "1-URGENT")))
    return left, right


SIDES = """
WITH lft AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice * (1 + 1e-13)
              WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN o_totalprice + 0.5
              ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderpriority = '1-URGENT' THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')),
rgt AS (SELECT * FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')),
diffs AS (
  SELECT o_orderkey, NULL AS field, 'missing' AS kind, NULL AS l, NULL AS r FROM rgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM lft)
  UNION ALL SELECT o_orderkey, NULL, 'extra', NULL, NULL FROM lft WHERE o_orderkey NOT IN (SELECT o_orderkey FROM rgt)
  UNION ALL SELECT lft.o_orderkey, 'o_totalprice', 'value', NULL, NULL FROM lft JOIN rgt USING (o_orderkey)
    WHERE abs(lft.o_totalprice - rgt.o_totalprice) > 1e-12 * greatest(abs(lft.o_totalprice), abs(rgt.o_totalprice))
  UNION ALL SELECT lft.o_orderkey, 'o_orderstatus', 'type', lft.o_orderstatus, rgt.o_orderstatus FROM lft JOIN rgt USING (o_orderkey)
    WHERE (lft.o_orderstatus IS NULL) <> (rgt.o_orderstatus IS NULL)
  UNION ALL SELECT lft.o_orderkey, 'o_orderstatus', 'value', lft.o_orderstatus, rgt.o_orderstatus FROM lft JOIN rgt USING (o_orderkey)
    WHERE lft.o_orderstatus <> rgt.o_orderstatus
  UNION ALL SELECT lft.o_orderkey, 'o_orderpriority', 'value', lft.o_orderpriority, rgt.o_orderpriority FROM lft JOIN rgt USING (o_orderkey)
    WHERE lft.o_orderpriority <> rgt.o_orderpriority)
"""


@query(
    "b01_json_type",
    """SELECT event_id, lower(CASE json_type(props) WHEN 'OBJECT' THEN 'object' ELSE 'other' END) AS root_type,
              CASE WHEN event_type = 'click' THEN 'string' WHEN event_type = 'view' THEN 'boolean'
                   WHEN event_type = 'error' THEN 'null' WHEN event_type = 'signup' THEN 'array' ELSE 'number' END AS k_type
       FROM events""",
)
def b01(spark, sf):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    doc = (
        F.when(kind == "click", F.concat(F.lit('"'), k, F.lit('"')))
        .when(kind == "view", F.lit("true"))
        .when(kind == "error", F.lit("null"))
        .when(kind == "signup", F.concat(F.lit("["), k, F.lit("]")))
        .otherwise(k)
    )
    events = table(spark, sf, "events")
    return events.select(
        "event_id", json_type(F.parse_json("props")).alias("root_type"), json_type(F.parse_json(doc)).alias("k_type")
    )


@query(
    "b02_number_equality",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag,
              abs(l_extendedprice - b) <= 1e-12 * greatest(abs(l_extendedprice), abs(b)) AND l_returnflag <> 'N' AS equal
       FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN l_extendedprice * (1 + 1e-13) WHEN 'A' THEN l_extendedprice * (1 + 1e-11)
                       ELSE l_extendedprice END AS b FROM lineitem)""",
)
def b02(spark, sf):
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    other = F.when(flag == "R", price * (1 + 1e-13)).when(flag == "A", price * (1 + 1e-11)).otherwise(F.lit(float("nan")))
    mine = F.when(flag == "N", F.lit(float("nan"))).otherwise(price)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", num_equal(mine, other).alias("equal")
    )


@query("b03_keyed_diff", SIDES + "SELECT o_orderkey, field, kind FROM diffs")
def b03(spark, sf):
    left, right = order_sides(spark, sf)
    return compare.diff(left, right, ["o_orderkey"], COLS).select("o_orderkey", "field", "kind")


@query("b05_null_and_absent", SIDES + "SELECT o_orderkey, kind, l AS left_value, r AS right_value FROM diffs WHERE field = 'o_orderstatus'")
def b05(spark, sf):
    left, right = order_sides(spark, sf)
    found = compare.diff(left, right, ["o_orderkey"], ["o_orderstatus"], unique=True)
    return found.where("field IS NOT NULL").select("o_orderkey", "kind", "left_value", "right_value")


DOC_L = """'{"kind":"' || event_type || '","tags":["' || event_type || '",' || user_id || '],"body":{"k":' || json_extract_string(props, '$.k') || ',"a/b":{"v":' || value || '}}}'"""


def event_docs(spark, sf):
    """Nested documents of events under test and expected."""
    e = table(spark, sf, "events", spread=True)
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")

    def doc(tags, body):
        return F.concat(F.lit('{"kind":"'), kind, F.lit('","tags":['), tags, F.lit(']'), body, F.lit("}"))

    quoted = F.concat(F.lit('"'), kind, F.lit('"'))
    user = F.col("user_id").cast("string")
    inner = F.concat(F.lit('{"v":'), user, F.lit("}"))
    right = doc(F.concat(quoted, F.lit(","), user), F.concat(F.lit(',"body":{"k":'), k, F.lit(',"a/b":'), inner, F.lit("}")))
    left = (
        F.when(kind == "click", doc(quoted, F.concat(F.lit(',"body":{"k":'), k, F.lit(',"a/b":'), inner, F.lit("}"))))
        .when(kind == "view", doc(F.concat(quoted, F.lit(","), user), F.lit("")))
        .when(kind == "error", doc(F.concat(quoted, F.lit(',"'), user, F.lit('"')), F.concat(F.lit(',"body":{"k":null,"a/b":'), inner, F.lit(',"z":[1,{"q":2}]}'))))
        .when(kind == "signup", doc(F.concat(quoted, F.lit(","), user, F.lit(".0")), F.concat(F.lit(',"body":{"a/b":[1],"k":'), k, F.lit("}"))))
        .otherwise(right)
    )
    docs = e.select("event_id", left.alias("_left"), right.alias("_right"))
    return (
        json_nodes(docs.select("event_id", F.col("_left").alias("j")), ["event_id"], "j"),
        json_nodes(docs.select("event_id", F.col("_right").alias("j")), ["event_id"], "j"),
    )


NESTED = """
SELECT event_id, '/tags' AS ptr, 'length' AS kind, 'array' AS left_type, 'array' AS right_type FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, '/body', 'missing', NULL, 'object' FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, '/tags/1', 'type', 'string', 'number' FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, '/body/k', 'type', 'null', 'number' FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, '/body/z', 'extra', 'array', NULL FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, '/body/a~1b', 'type', 'array', 'object' FROM events WHERE event_type = 'signup'
"""


@query("b04_nested_diff", NESTED)
def b04(spark, sf):
    left, right = event_docs(spark, sf)
    return compare.diff_nodes(left, right, ["event_id"]).select("event_id", "ptr", "kind", "left_type", "right_type")


@query(
    "b06_array_diff",
    """WITH p AS (SELECT vec_id, embedding AS l,
                    CASE WHEN label % 3 = 0 THEN embedding[1:40] WHEN label % 3 = 1 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS r
             FROM embeddings)
       SELECT vec_id, 'length' AS kind, NULL::INTEGER AS index, len(l)::DOUBLE AS left_value, len(r)::DOUBLE AS right_value FROM p WHERE len(l) <> len(r)
       UNION ALL
       SELECT vec_id, 'value', (i - 1)::INTEGER, l[i]::DOUBLE, r[i]::DOUBLE
       FROM (SELECT *, unnest(generate_series(1, least(len(l), len(r)))) AS i FROM p)
       WHERE l[i]::DOUBLE <> r[i]::DOUBLE""",
)
def b06(spark, sf):
    e = table(spark, sf, "embeddings", spread=True)
    other = (
        F.when(F.col("label") % 3 == 0, F.slice("embedding", 1, 40))
        .when(F.col("label") % 3 == 1, F.transform("embedding", lambda x: -x))
        .otherwise(F.col("embedding"))
    )
    return compare.diff_arrays(e, e.select("vec_id", other.alias("embedding")), ["vec_id"], "embedding")


@query(
    "b07_exact_text",
    """SELECT p_partkey, 'p_name' AS field, 'value' AS kind,
              CASE p_type WHEN 'PROMO' THEN upper(p_name) WHEN 'SMALL' THEN p_name || ' ' ELSE p_name END AS left_value, p_name AS right_value
       FROM part WHERE p_type IN ('PROMO', 'SMALL')""",
)
def b07(spark, sf):
    p = table(spark, sf, "part")
    kind, name = F.col("p_type"), F.col("p_name")
    mine = F.when(kind == "PROMO", F.upper(name)).when(kind == "SMALL", F.concat(name, F.lit(" "))).otherwise(name)
    return compare.diff(p.select("p_partkey", mine.alias("p_name")), p, ["p_partkey"], ["p_name"], unique=True)


BAGS = """
WITH a AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE value < 20 GROUP BY ALL),
     b AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE value >= 20 GROUP BY ALL),
     both_sides AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.user_id, b.user_id) AS user_id,
                           coalesce(a.n, 0) - coalesce(b.n, 0) AS s
                    FROM a FULL JOIN b ON a.event_type = b.event_type AND a.user_id = b.user_id)
"""


def event_bags(spark, sf):
    e = table(spark, sf, "events")
    return e.where("value < 20"), e.where("value >= 20")


@query(
    "b08_multiset_diff",
    BAGS + """SELECT CASE WHEN s > 0 THEN 'left' ELSE 'right' END AS side, event_type, user_id::DOUBLE AS user_id, abs(s)::BIGINT AS n
              FROM both_sides WHERE s <> 0""",
)
def b08(spark, sf):
    return compare.multiset_diff(*event_bags(spark, sf), ["event_type", "user_id"])


@query(
    "b08_multiset_rows",
    BAGS + """SELECT side, event_type, user_id, unnest(generate_series(1, n)) AS copy FROM (
                SELECT CASE WHEN s > 0 THEN 'left' ELSE 'right' END AS side, event_type, user_id::DOUBLE AS user_id, abs(s)::BIGINT AS n
                FROM both_sides WHERE s <> 0)""",
)
def b08_rows(spark, sf):
    return compare.expand_bag(compare.multiset_diff(*event_bags(spark, sf), ["event_type", "user_id"]))


@query(
    "b09_pairing_key",
    """SELECT 'left' AS side, l_returnflag, l_linenumber::DOUBLE AS l_linenumber, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL
       UNION ALL
       SELECT 'right', l_returnflag, l_linenumber::DOUBLE, count(*) FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL""",
)
def b09(spark, sf):
    # One number is made NaN on both sides: such elements pair with nothing, themselves included.
    number = F.when(F.col("l_linestatus") == "F", F.lit(float("nan"))).otherwise(F.col("l_discount"))
    left = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", number.alias("value"))
    right = left.select("l_returnflag", F.col("l_linenumber").cast("double").alias("l_linenumber"), "value")
    return compare.multiset_diff(left, right, ["l_returnflag", "l_linenumber", "value"]).drop("value")


@query(
    "b10_difference_order",
    """WITH d AS (""" + NESTED + """),
       placed AS (SELECT *, CASE ptr WHEN '/tags' THEN 1 WHEN '/tags/1' THEN 2 WHEN '/body/k' THEN 3 WHEN '/body/a~1b' THEN 4
                                     WHEN '/body/z' THEN 5 ELSE 6 END AS place FROM d)
       SELECT event_id, ptr, kind, row_number() OVER (PARTITION BY event_id ORDER BY place) AS at FROM placed""",
)
def b10(spark, sf):
    left, right = event_docs(spark, sf)
    ids = ["event_id"]
    placed = compare.diff_nodes(left, right, ids)
    # The order is the result; it is numbered within each document so that a bag comparison sees it.
    number = F.row_number().over(Window.partitionBy("event_id").orderBy("place", "ptr"))
    return placed.select("event_id", "ptr", "kind", number.cast("long").alias("at"))


@query(
    "b11_first_and_total",
    SIDES
    + """, flagged AS (SELECT kind, coalesce(field, '') AS field, o_orderkey FROM diffs)
       SELECT kind, field, o_orderkey, row_number() OVER (PARTITION BY kind ORDER BY o_orderkey, field) AS rank,
              count(*) OVER (PARTITION BY kind) AS total FROM flagged QUALIFY rank <= 10""",
)
def b11(spark, sf):
    left, right = order_sides(spark, sf)
    found = compare.diff(left, right, ["o_orderkey"], COLS, unique=True).select(
        "kind", F.coalesce("field", F.lit("")).alias("field"), "o_orderkey"
    )
    return compare.total_and_first(found, ["kind"], [F.col("o_orderkey"), F.col("field")], 10).withColumn(
        "rank", F.col("rank").cast("long")
    )


@query("b12_outcome", "SELECT doc_id, 'value' AS kind, toxic AS left_value, quality AS right_value FROM labels WHERE quality <> toxic")
def b12(spark, sf):
    return compare.diff_outcome(table(spark, sf, "labels"), ["doc_id"], "quality", "toxic")


@query(
    "b13_field_order",
    """WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
            b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE event_type <> 'signup'),
            c AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.pos, a.event_type AS l, b.event_type AS r FROM a JOIN b ON a.user_id = b.user_id AND a.pos = b.pos)
       SELECT user_id, pos, 'value' AS kind, l AS left_value, r AS right_value FROM c WHERE l <> r
       UNION ALL
       SELECT x.user_id, NULL, 'length', x.n::VARCHAR, y.n::VARCHAR FROM (SELECT user_id, count(*) AS n FROM a GROUP BY 1) x
       JOIN (SELECT user_id, count(*) AS n FROM b GROUP BY 1) y ON x.user_id = y.user_id AND x.n <> y.n""",
)
def b13(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    left = blocked_number(e, ["user_id"], "event_id", "pos")
    right = blocked_number(e.where("event_type <> 'signup'"), ["user_id"], "event_id", "pos")
    return compare.diff_sequence(left, right, ["user_id"], "pos", ["event_type"])


def drift_pairs(spark, sf):
    """Documents and edited copies of equal length; German texts lose their last character."""
    d = table(spark, sf, "documents", spread=True).select("doc_id", "lang", "text")
    edited = F.when(F.col("lang") == "de", F.expr("left(text, length(text) - 1)")).otherwise(
        F.translate("text", "TÉ", "#$")
    )
    return d.select("doc_id", "lang", edited.alias("written"), F.col("text").alias("source"))


DRIFT = """
WITH p AS (SELECT doc_id, lang, text, CASE WHEN lang = 'de' THEN left(text, length(text) - 1) ELSE translate(text, 'TÉ', '#$') END AS written FROM documents),
spots AS (SELECT doc_id, unnest(list_filter(generate_series(1, length(text)), lambda i: {where})) AS i
          FROM (SELECT *, string_split(text, '') AS a, string_split(written, '') AS b FROM p WHERE lang <> 'de')),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 8 THEN 0 ELSE 1 END AS opens FROM spots),
grouped AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM marked),
regions AS (SELECT doc_id, min(i) - 1 AS off, max(i) - min(i) + 1 AS n FROM grouped GROUP BY doc_id, g
            UNION ALL SELECT doc_id, length(written), 0 FROM p WHERE lang = 'de')
"""


@query(
    "b14_text_drift",
    DRIFT.format(where="a[i] <> b[i]")
    + """SELECT doc_id, off AS "offset", (length(left(written, off)) - length(replace(left(written, off), chr(10), '')) + 1) AS line,
              (off - CASE WHEN contains(left(written, off), chr(10)) THEN off - strpos(reverse(left(written, off)), chr(10)) + 1 ELSE 0 END + 1) AS "column",
              off AS right_offset, substr(written, off + 1, n) AS left_text,
              CASE WHEN lang = 'de' THEN right(text, 1) ELSE substr(text, off + 1, n) END AS right_text
       FROM regions JOIN p USING (doc_id)""",
)
def b14(spark, sf):
    found = text_drift(drift_pairs(spark, sf), ["doc_id"], "written", "source")
    return found.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("offset", "line", "column", "right_offset")], "left_text", "right_text"
    )


@query(
    "b15_line_and_column",
    """SELECT doc_id, off AS "offset", length(b) - length(replace(b, chr(10), '')) + 1 AS line,
              length(b) - (CASE WHEN contains(b, chr(10)) THEN length(b) - strpos(reverse(b), chr(10)) + 1 ELSE 0 END) + 1 AS "column"
       FROM (SELECT doc_id, off, left(text, off) AS b FROM (SELECT doc_id, text, length(text) // 2 AS off FROM documents))""",
)
def b15(spark, sf):
    off = F.floor(F.length("text") / 2)
    line, column = line_col(F.col("text"), off.cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", off.alias("offset"), line.cast("long").alias("line"), column.cast("long").alias("column")
    )


SPANS = """
WITH s AS (SELECT l_suppkey AS k, l_orderkey AS a, l_orderkey + l_linenumber * 3 AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT k, min(a) AS a, max(b) AS b FROM g GROUP BY k, g
"""


@query("b16_merge_spans", SPANS)
def b16(spark, sf):
    line = table(spark, sf, "lineitem")
    spans = line.select(
        F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_linenumber") * 3).alias("b")
    )
    return compare.merge_spans(spans, ["k"], "a", "b", rows=2000)


@query(
    "b17_drift_outside_spans",
    DRIFT.format(where="a[i] <> b[i] AND i > 20")
    + """SELECT doc_id, off AS "offset", off AS right_offset, substr(written, off + 1, n) AS left_text, substr(text, off + 1, n) AS right_text
       FROM regions JOIN p USING (doc_id) WHERE lang <> 'de'
       UNION ALL SELECT doc_id, length(written), length(written), '', right(text, 1) FROM p WHERE lang = 'de' AND length(text) > 20""",
)
def b17(spark, sf):
    # The first twenty characters are one excluded span on both sides; a text that is not longer is all excluded.
    pairs = drift_pairs(spark, sf)
    span = lambda text: F.array(F.struct(F.lit(0).alias("start"), F.least(F.lit(20), F.length(text)).alias("end")))
    found = text_drift(pairs.withColumns({"ls": span("written"), "rs": span("source")}), ["doc_id"], "written", "source", "ls", "rs")
    return found.select(
        "doc_id", F.col("offset").cast("long").alias("offset"), F.col("right_offset").cast("long").alias("right_offset"), "left_text", "right_text"
    )


@query(
    "b18_drift_window",
    """SELECT doc_id, left(text, 80) || CASE WHEN length(text) > 80 THEN ' (+' || (length(text) - 80) || ' more)' ELSE '' END AS shown FROM documents""",
)
def b18(spark, sf):
    # Against an empty text the whole document is one region.
    pairs = table(spark, sf, "documents", spread=True).select("doc_id", "text", F.lit("").alias("nothing"))
    found = text_drift(pairs, ["doc_id"], "text", "nothing")
    return found.select("doc_id", drift_window(F.col("left_text")).alias("shown"))
