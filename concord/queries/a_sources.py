"""Scans, sources and sinks over the driver's tables."""

from pyspark.sql import functions as F

from concord.operators.nodes import json_nodes, json_rejects
from concord.queries.registry import query, table
from concord.sources.corpus import decode_audit, drop_oversize, scan_corpus, scratch_folder, with_contents
from concord.sources.hourly import hourly_rows
from concord.sources.report import write_findings
from concord.sources.rings import parse_rings, read_rings, report_rows, ring_lines, ring_rejects
from concord.sources.statements import statements

# Rings of 32 vertices: coordinates in pairs from the vector, the label as height.
RINGS = """
WITH flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)
"""


def embedding_rings(spark, sf):
    """Each vector as a closed ring: consecutive pairs are x and y, the label is z."""
    e = table(spark, sf, "embeddings", spread=True)
    ring = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1),
        lambda i: F.struct(
            F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y"), F.col("label").cast("double").alias("z")
        ),
    )
    return e.select("vec_id", "label", ring.alias("vertices"))


@query("a01_corpus_scan", "SELECT lang, sum(octet_length(encode(text)) + 1)::BIGINT AS size, sum(octet_length(encode(text)) + 1)::BIGINT AS content FROM documents GROUP BY lang")
def a01(spark, sf):
    # The corpus is written from the documents: files of lines, a folder for each language.
    folder = scratch_folder(spark, "corpus")
    table(spark, sf, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(folder)
    listing = scan_corpus(spark, folder, "*.txt")
    read = with_contents(spark, listing, folder, "*.txt")
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")
    return read.groupBy(lang).agg(F.sum("size").alias("size"), F.sum(F.octet_length("content")).cast("long").alias("content"))


@query(
    "a02_size_guard",
    "SELECT doc_id, lang, length(text) AS characters FROM documents WHERE length(text) <= 5000",
)
def a02(spark, sf):
    kept = drop_oversize(table(spark, sf, "documents"), "text", 5000)
    return kept.select("doc_id", "lang", F.length("text").alias("characters"))


@query(
    "a03_decode_audit",
    """SELECT doc_id,
              CASE WHEN lang = 'fr' THEN length(text) ELSE octet_length(encode(text)) END::BIGINT AS latin1_chars,
              octet_length(encode(text)) <> length(text) AS differ
       FROM documents""",
)
def a03(spark, sf):
    docs = table(spark, sf, "documents")
    content = F.when(F.col("lang") == "fr", F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    audit = decode_audit(docs.select("doc_id", content.alias("content")), ["doc_id"])
    return audit.select("doc_id", F.col("latin1_chars").cast("long").alias("latin1_chars"), "differ")


@query(
    "a04_json_nodes",
    """SELECT event_id, '' AS ptr, 0 AS depth, 'object' AS jtype, NULL::DOUBLE AS num, 0::BIGINT AS ord, length(props) - 1 AS stop FROM events
       UNION ALL
       SELECT event_id, '/k', 1, 'number', json_extract(props, '$.k')::DOUBLE, strpos(props, ':') + length(regexp_extract(props, ':( *)', 1)), NULL FROM events""",
)
def a04(spark, sf):
    return json_nodes(table(spark, sf, "events", spread=True), ["event_id"], "props").select("event_id", "ptr", "depth", "jtype", "num", "ord", "stop")


@query(
    "a04_json_rejects",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'text ends early' WHEN event_id % 11 = 0 THEN 'no text' WHEN event_id % 13 = 0 THEN 'repeated name' ELSE 'nested too deep' END AS reason,
              CASE WHEN event_id % 7 = 0 THEN length(props) - 1 WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 7 ELSE 41 END::BIGINT AS "offset"
       FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0""",
)
def a04_rejects(spark, sf):
    # Cut off, missing, with a repeated name, and nested one level too deep (others just not).
    i, props = F.col("event_id"), F.col("props")
    deep = lambda n: F.concat(F.repeat(F.lit("["), F.lit(n)), props, F.repeat(F.lit("]"), F.lit(n)))
    broken = (
        F.when(i % 7 == 0, F.expr("left(props, length(props) - 1)")).when(i % 11 == 0, None).when(i % 13 == 0, F.concat(F.lit('{"x":1,"x":2,'), F.expr("substring(props, 2)")))
        .when(i % 17 == 0, deep(41)).otherwise(deep(39))
    )
    return json_rejects(table(spark, sf, "events").select("event_id", broken.alias("json")), ["event_id"], "json", 40)


PART_STATEMENTS = """SELECT p_partkey, 1 AS seq, 1 AS line, p_type AS obj_type, 0 AS pos, p_name AS raw FROM part
       UNION ALL SELECT p_partkey, 1, 1, p_type, 1, p_size::VARCHAR FROM part
       UNION ALL SELECT p_partkey, 2, 4, 'Brand', 0, p_brand FROM part
       UNION ALL SELECT p_partkey, 2, 4, 'Brand', 1, '' FROM part
       UNION ALL SELECT p_partkey, 2, 4, 'Brand', 2, 'two lines' FROM part"""


def part_texts(spark, sf):
    part = table(spark, sf, "part", spread=True)
    text = F.concat(
        F.col("p_type"), F.lit(",\n  "), F.col("p_name"), F.lit(", "), F.col("p_size").cast("string"),
        F.lit("; ! a stray, comment;\n! a whole line;\nBrand, "), F.col("p_brand"), F.lit(", , two\n  lines;\n"),
    )
    return part.select("p_partkey", "p_type", "p_size", text.alias("content"))


@query("a05_statements", PART_STATEMENTS)
def a05(spark, sf):
    return statements(part_texts(spark, sf), ["p_partkey"]).select("p_partkey", "seq", "line", "obj_type", "pos", "raw")


@query(
    "a05_statement_pieces",
    f"""WITH s AS ({PART_STATEMENTS}), f AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS n FROM part)
       SELECT f.p_type, 2 * n + seq AS seq, 5 * n + line AS line, obj_type, pos, raw FROM s JOIN f USING (p_partkey)""",
)
def a05_pieces(spark, sf):
    # One file a type, of the texts of its parts one after the other, cut into pieces inside every one of them.
    texts = part_texts(spark, sf)
    cut = (F.col("p_size") % F.length("content") + 1).cast("int")
    pieces = texts.select("p_type", "p_partkey", F.posexplode(F.array(F.expr("left(content, p_size % length(content) + 1)"), F.substring("content", cut + 1, F.length("content")))).alias("half", "content"))
    numbered = pieces.withColumn("at", F.col("p_partkey") * 2 + F.col("half"))
    return statements(numbered, ["p_type"], at="at").select("p_type", "seq", "line", "obj_type", "pos", "raw")


@query(
    "a06_ring_lines",
    RINGS
    + """SELECT vec_id, 'v' || vec_id AS name, (i - 1) // 2 AS at,
              round(max(CASE WHEN i % 2 = 1 THEN e END), 2) AS x, round(max(CASE WHEN i % 2 = 0 THEN e END), 2) AS y,
              max(label)::DOUBLE AS z
       FROM flat GROUP BY vec_id, (i - 1) // 2""",
)
def a06(spark, sf):
    rings = embedding_rings(spark, sf).select(
        "vec_id", F.lit("HeatTransfer Surface").alias("kind"), F.concat(F.lit("v"), "vec_id").alias("name"),
        F.lit("Wall, outer").alias("surface_class"), F.lit(None).cast("string").alias("base_surface"), "vertices",
    )
    back = parse_rings(ring_lines(rings, ["vec_id"]), ["vec_id"])
    return back.select("vec_id", "name", F.posexplode("vertices").alias("at", "_v")).select(
        "vec_id", "name", F.col("at").cast("long").alias("at"), "_v.x", "_v.y", "_v.z"
    )


@query(
    "a06_ring_file",
    """SELECT 'v' || vec_id AS name, CASE WHEN vec_id % 5 <> 0 THEN len(embedding) // 2 END::BIGINT AS vertices,
              CASE WHEN vec_id % 5 = 0 THEN (len(embedding) // 2) || ' vertices stated, ' || (len(embedding) // 2 * 3 - 1) || ' numbers' END AS reject FROM embeddings""",
)
def a06_file(spark, sf):
    rings = embedding_rings(spark, sf).select(
        F.lit("Shading Surface").alias("kind"), F.concat(F.lit("v"), "vec_id").alias("name"),
        F.lit("Wall").alias("surface_class"), F.lit("").alias("base_surface"), "vertices", "vec_id",
    )
    folder = scratch_folder(spark, "rings")
    # Every fifth line loses its last number.
    line = F.when(F.col("vec_id") % 5 == 0, F.regexp_replace("value", ",[^,]*$", "")).otherwise(F.col("value"))
    ring_lines(rings, ["vec_id"]).select(line.alias("value")).write.text(folder)
    kept = read_rings(spark, folder).select("name", F.size("vertices").cast("long").alias("vertices"), F.lit(None).cast("string").alias("reject"))
    lines = spark.read.text(folder)
    return kept.unionByName(ring_rejects(lines).select("name", F.lit(None).cast("long").alias("vertices"), "reject"))


@query(
    "a07_report_rows",
    """SELECT vec_id, 'v' || vec_id AS name, CASE WHEN label = 3 THEN 'reject' ELSE 'ring' END AS found,
              CASE WHEN label = 3 THEN len(embedding) // 2 + 1 ELSE len(embedding) // 2 END::BIGINT AS sides
       FROM embeddings WHERE label <> 7""",
)
def a07(spark, sf):
    rings = embedding_rings(spark, sf)
    cells = F.flatten(F.transform("vertices", lambda v: F.array(*[v[a].cast("string") for a in "xyz"])))
    said = F.size("vertices") + (F.col("label") == 3).cast("int")
    kind = F.when(F.col("label") == 7, "Zone Surfaces").when(F.col("label") % 2 == 0, "Shading Surface").otherwise("HeatTransfer Surface")
    line = F.concat_ws(
        ", ", kind, F.concat(F.lit("v"), "vec_id"), F.lit("Wall"), F.lit(""), F.array_repeat(F.lit("0"), 22), said.cast("string"), cells
    )
    kept, rejects = report_rows(rings.select("vec_id", F.replace(line, F.lit(", "), F.lit(",")).alias("value")), ["vec_id"])
    return kept.select("vec_id", "name", F.lit("ring").alias("found"), F.size("vertices").cast("long").alias("sides")).unionByName(
        rejects.select("vec_id", "name", F.lit("reject").alias("found"), F.col("sides").cast("long").alias("sides"))
    )


@query(
    "a08_hourly_file",
    """SELECT o_orderkey AS orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, o_totalprice AS price
       FROM orders""",
)
def a08(spark, sf):
    # One file per hundred order keys: keys are unique, so no file holds more than a hundred rows.
    orders = table(spark, sf, "orders").withColumn("file", F.floor(F.col("o_orderkey") / 100))
    line = F.concat_ws(
        ",", F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string"),
        F.month("o_orderdate").cast("string"), F.col("o_totalprice").cast("string"),
    )
    head = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("HEADER,"), i.cast("string"))), "\r\n")
    ending = F.when(F.col("file") % 2 == 0, "\r\n").otherwise("\r")
    files = orders.groupBy("file").agg(F.array_sort(F.collect_list(line)).alias("lines")).select(
        "file", F.concat(head, F.lit("\n"), F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\r\n"))), ""), ending).alias("content")
    )
    positions = {0: ("orderkey", "long"), 1: ("year", "long"), 2: ("month", "long"), 3: ("price", "double")}
    return hourly_rows(files, ["file"], positions).drop("file", "row")


@query("a09_report_sink", "SELECT l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def a09(spark, sf):
    folder = scratch_folder(spark, "findings")
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), "l_orderkey", "l_linenumber", "l_quantity")
    write_findings(lines, folder)
    return spark.read.parquet(folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
