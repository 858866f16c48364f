"""N-way sweep over three versions of the part table."""

from pyspark.sql import functions as F

from concord.functions.json import pointer_pattern, preview
from concord.operators import sweep
from concord.operators.nodes import json_nodes, record_nodes
from concord.queries.registry import query, table

SIDES = ["alpha", "beta", "truth"]


def part_nodes(spark, sf):
    """Three versions of every part as leaves; one brand is one file."""
    p = table(spark, sf, "part")
    kind, name, size, price = F.col("p_type"), F.col("p_name"), F.col("p_size"), F.col("p_retailprice")
    path = F.concat(F.lit("/"), kind, F.lit("/"), F.col("p_partkey").cast("string"))

    def side(label, fields):
        return record_nodes(p, ["p_brand"], path, fields).withColumn("side", F.lit(label))

    alpha = side(
        "alpha",
        {
            "name": F.when(kind == "PROMO", F.upper(name)).otherwise(name),
            "size": F.when(kind != "LARGE", size),
            "price": F.when(kind == "ECONOMY", price + 1).when(kind == "STANDARD", F.lit(float("nan"))).otherwise(price),
        },
    )
    beta_fields = {
        "name": name,
        "size": F.when(kind != "MEDIUM", size),
        "price": F.when(kind == "ECONOMY", price + 2).when(kind == "SMALL", price * 1.01).when(kind == "STANDARD", F.lit(float("nan"))).otherwise(price),
    }
    beta = side("beta", beta_fields).unionByName(side("beta", {"size": F.when(kind == "MEDIUM", size.cast("string"))}))
    truth = side(
        "truth", {"name": name, "size": size, "price": F.when(kind == "STANDARD", F.lit(float("nan"))).otherwise(price * (1 + 1e-13))}
    )
    return alpha.unionByName(beta).unionByName(truth)


def part_diffs(spark, sf):
    return sweep.sweep_diff(sweep.align_sides(part_nodes(spark, sf), ["p_brand"], SIDES), ["p_brand"], SIDES, nested=False)


DIFFS = """
WITH spots AS (
  SELECT *, CASE p_type WHEN 'PROMO' THEN 'name' WHEN 'LARGE' THEN 'size' WHEN 'MEDIUM' THEN 'size' WHEN 'ECONOMY' THEN 'price' WHEN 'SMALL' THEN 'price' END AS field,
         CASE p_type WHEN 'LARGE' THEN 'absent' WHEN 'MEDIUM' THEN 'type' ELSE 'value' END AS kind,
         CASE p_type WHEN 'PROMO' THEN 'alpha | beta=truth' WHEN 'LARGE' THEN 'alpha | beta=truth' WHEN 'ECONOMY' THEN 'alpha | beta | truth' ELSE 'alpha=truth | beta' END AS partition,
         CASE p_type WHEN 'PROMO' THEN 'alpha' WHEN 'LARGE' THEN 'alpha' WHEN 'ECONOMY' THEN 'alpha,beta,truth' ELSE 'beta' END AS differing_sides,
         CASE p_type WHEN 'PROMO' THEN 'alpha=string,beta=string,truth=string' WHEN 'LARGE' THEN 'alpha=absent,beta=number,truth=number'
                     WHEN 'MEDIUM' THEN 'alpha=number,beta=string,truth=number' ELSE 'alpha=number,beta=number,truth=number' END AS value_types
  FROM part WHERE p_type <> 'STANDARD'),
diffs AS (
  SELECT *, '/' || p_type || '/' || p_partkey || '/' || field AS ptr, '/' || p_type || '/*/' || field AS pattern,
         kind || '::' || partition || '::' || '/' || p_type || '/*/' || field || '::' || value_types AS shape FROM spots)
"""


@query(
    "c01_align_sides",
    """SELECT p_brand, '/' || p_type || '/' || p_partkey || '/size' AS ptr, p_type <> 'LARGE' AS in_alpha, true AS in_beta, true AS in_truth FROM part
       UNION ALL SELECT p_brand, '/' || p_type || '/' || p_partkey || '/name', true, true, true FROM part
       UNION ALL SELECT p_brand, '/' || p_type || '/' || p_partkey || '/price', true, true, true FROM part""",
)
def c01(spark, sf):
    aligned = sweep.align_sides(part_nodes(spark, sf), ["p_brand"], SIDES)
    return aligned.select("p_brand", "ptr", *[F.col(s).isNotNull().alias(f"in_{s}") for s in SIDES])


@query("c02_partition_label", DIFFS + "SELECT p_brand, ptr, partition FROM diffs")
def c02(spark, sf):
    return part_diffs(spark, sf).select("p_brand", "ptr", "partition")


@query("c03_nan_equals_nan", "SELECT count(*) AS nan_places, 0::BIGINT AS differing FROM part WHERE p_type = 'STANDARD'")
def c03(spark, sf):
    aligned = sweep.align_sides(part_nodes(spark, sf), ["p_brand"], SIDES).where(F.isnan("truth.num"))
    differing = sweep.sweep_diff(aligned, ["p_brand"], SIDES, nested=False)
    places = aligned.select(F.lit(1).alias("place"), F.lit(0).alias("differs")).unionByName(differing.select(F.lit(0).alias("place"), F.lit(1).alias("differs")))
    return places.agg(F.sum("place").alias("nan_places"), F.sum("differs").alias("differing"))


@query("c04_sweep_kinds", DIFFS + "SELECT p_brand, ptr, kind, value_types FROM diffs")
def c04(spark, sf):
    return part_diffs(spark, sf).select("p_brand", "ptr", "kind", "value_types")


@query(
    "c04_nested_sweep",
    """SELECT event_id, '/tags' AS ptr, 'length' AS kind, 'alpha | beta=truth' AS partition FROM events WHERE event_type = 'click'
       UNION ALL SELECT event_id, '/body', 'absent', 'alpha=truth | beta' FROM events WHERE event_type = 'view'
       UNION ALL SELECT event_id, '/body', 'type', 'alpha=beta | truth' FROM events WHERE event_type = 'error'
       UNION ALL SELECT event_id, '/body', 'type', 'alpha | beta | truth' FROM events WHERE event_type = 'signup'
       UNION ALL SELECT event_id, '/body/k', 'value', 'alpha | beta | truth' FROM events WHERE event_type = 'purchase'""",
)
def c04_nested(spark, sf):
    e = table(spark, sf, "events", spread=True)
    kind, k, user = F.col("event_type"), F.get_json_object("props", "$.k"), F.col("user_id").cast("string")

    def doc(tags, body):
        return F.concat(F.lit('{"tags":['), tags, F.lit("]"), body, F.lit("}"))

    two = F.concat(user, F.lit(","), k)
    body = F.concat(F.lit(',"body":{"k":'), k, F.lit("}"))
    other = F.concat(F.lit(',"body":{"k":'), k, F.lit(".5}"))
    half = F.concat(F.lit(',"body":{"k":'), k, F.lit(".25}"))
    versions = {
        "alpha": F.when(kind == "click", doc(user, body)).otherwise(doc(two, body)),
        "beta": F.when(kind == "view", doc(two, F.lit(""))).when(kind.isin("signup", "purchase"), doc(two, other)).otherwise(doc(two, body)),
        "truth": F.when(kind.isin("error", "signup"), doc(two, F.lit(',"body":[1]'))).when(kind == "purchase", doc(two, half)).otherwise(doc(two, body)),
    }
    sides = None
    for side, text in versions.items():
        nodes = json_nodes(e.select("event_id", text.alias("j")), ["event_id"], "j").withColumn("side", F.lit(side))
        sides = nodes if sides is None else sides.unionByName(nodes)
    diffs = sweep.sweep_diff(sweep.align_sides(sides, ["event_id"], SIDES), ["event_id"], SIDES)
    return diffs.select("event_id", "ptr", "kind", "partition")


@query("c05_minority_sides", DIFFS + "SELECT p_brand, ptr, differing_sides FROM diffs")
def c05(spark, sf):
    return part_diffs(spark, sf).select("p_brand", "ptr", "differing_sides")


@query(
    "c06_pointer_pattern",
    r"""WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+(/.*)?$', 1) AS ptr FROM pages),
       t AS (SELECT page_id, ptr, unnest(string_split(ptr, '/')[2:]) AS token, generate_subscripts(string_split(ptr, '/')[2:], 1) AS i FROM p WHERE ptr <> '')
       SELECT page_id, '/' || string_agg(CASE WHEN i = 2 THEN '*' WHEN regexp_full_match(token, '\d+') THEN '#' ELSE token END, '/' ORDER BY i) AS pattern
       FROM t GROUP BY page_id
       UNION ALL SELECT page_id, '/' FROM p WHERE ptr = ''""",
)
def c06(spark, sf):
    path = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]+(/.*)?$", 1)
    return table(spark, sf, "pages").select("page_id", pointer_pattern(path).alias("pattern"))


@query(
    "c07_error_pattern",
    r"""WITH m AS (SELECT doc_id AS id, text AS msg FROM documents UNION ALL SELECT -1 - page_id, 'failed at ' || url || ' line ' || page_id FROM pages)
       SELECT id, CASE WHEN regexp_replace(msg, '\s+', '', 'g') = '' THEN '<no message>'
         ELSE left(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(msg, '^\s+', ''), '^[^\r\n]*'), '(?:/[^\s''"]+)+', '<path>', 'g'), '\d+', '#', 'g')), 300) END AS pattern
       FROM m""",
)
def c07(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("msg"))
    pages = table(spark, sf, "pages").select(
        (-1 - F.col("page_id")).alias("id"), F.concat(F.lit("failed at "), "url", F.lit(" line "), "page_id").alias("msg")
    )
    return docs.unionByName(pages).select("id", sweep.error_pattern(F.col("msg")).alias("pattern"))


@query("c08_shape_key", DIFFS + "SELECT shape, count(*) AS n FROM diffs GROUP BY 1")
def c08(spark, sf):
    return part_diffs(spark, sf).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c09_cap_per_file",
    """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey) AS n,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM lineitem)
       SELECT l_orderkey, l_partkey, l_suppkey, n > 3 AS truncated FROM l WHERE rn <= 3""",
)
def c09(spark, sf):
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")]
    kept = sweep.cap_per_file(table(spark, sf, "lineitem"), ["l_orderkey"], order, 3)
    return kept.select("l_orderkey", "l_partkey", "l_suppkey", "truncated")


@query(
    "c10_disagreement_groups",
    DIFFS
    + """SELECT shape, count(*) AS occurrences, count(DISTINCT p_brand) AS file_count,
              array_to_string((list_sort(list(DISTINCT p_brand)))[1:5], ',') AS files, min(p_brand) AS example_file
       FROM diffs GROUP BY shape""",
)
def c10(spark, sf):
    groups = sweep.ordered_groups(sweep.group_shapes(part_diffs(spark, sf), "p_brand", 5))
    return groups.select("shape", "occurrences", "file_count", F.array_join("files", ",").alias("files"), "example_file")


@query(
    "c11_families",
    DIFFS
    + """SELECT kind, partition, value_types, count(*) AS occurrences, count(DISTINCT shape) AS shape_count, count(DISTINCT p_brand) AS file_count
       FROM diffs GROUP BY ALL""",
)
def c11(spark, sf):
    return sweep.group_families(part_diffs(spark, sf), "p_brand", 5).drop("pointer_patterns", "family")


@query(
    "c12_outcome_groups",
    """SELECT side, 'cannot read #' AS error_pattern, count(DISTINCT user_id) AS file_count, min(user_id) AS example_file
       FROM (SELECT user_id, CASE WHEN value < 20 THEN 'alpha' ELSE 'beta' END AS side FROM events WHERE event_type = 'error') GROUP BY side""",
)
def c12(spark, sf):
    e = table(spark, sf, "events")
    outcomes = e.select(
        "user_id",
        F.when(F.col("value") < 20, "alpha").otherwise("beta").alias("side"),
        (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("cannot read "), F.col("event_id").cast("string")).alias("error"),
    )
    return sweep.group_outcomes(outcomes, "user_id", 5).select("side", "error_pattern", "file_count", "example_file")


@query(
    "c13_sweep_totals",
    DIFFS
    + """SELECT (SELECT count(DISTINCT p_brand) FROM part) AS files_seen,
              (SELECT count(*) FROM (SELECT p_brand FROM part GROUP BY 1 HAVING min(p_size) > 1)) AS files_all_ok,
              (SELECT count(DISTINCT p_brand) FROM diffs) AS files_with_differences,
              (SELECT count(DISTINCT p_brand) FROM part WHERE p_brand NOT IN (SELECT p_brand FROM diffs)) AS files_clean,
              (SELECT count(*) FROM diffs) AS differences_total,
              (SELECT count(*) FROM (SELECT p_brand FROM part GROUP BY 1 HAVING min(p_size) = 1)) AS failures_alpha,
              0::BIGINT AS failures_beta, 0::BIGINT AS failures_truth,
              (SELECT count(DISTINCT shape) FROM diffs) AS distinct_shapes,
              (SELECT count(*) FROM (SELECT DISTINCT kind, partition, value_types FROM diffs)) AS distinct_families""",
)
def c13(spark, sf):
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_size").alias("low"))
    outcomes = brands.select(
        "p_brand", F.explode(F.array(*[F.lit(s) for s in SIDES])).alias("side"), "low"
    ).select("p_brand", "side", ((F.col("side") != "alpha") | (F.col("low") > 1)).alias("ok"))
    return sweep.sweep_totals(outcomes, part_diffs(spark, sf), ["p_brand"], SIDES)


@query(
    "c14_value_preview",
    """SELECT p_partkey, CASE WHEN length(j) > 24 THEN left(j, 24) || '...' ELSE j END AS shown
       FROM (SELECT p_partkey, '{"n":"' || p_name || '","s":' || p_size || '}' AS j FROM part)""",
)
def c14(spark, sf):
    text = F.to_json(F.struct(F.col("p_name").alias("n"), F.col("p_size").alias("s")))
    return table(spark, sf, "part").select("p_partkey", preview(text, 24).alias("shown"))
