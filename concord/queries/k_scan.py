"""Text scans over documents, pages and conversations."""

from pyspark.sql import functions as F

from concord.functions.globs import glob_regex
from concord.operators import scan as k
from concord.queries.registry import query, table

NAMES = ["the", "un", "der", "que", "ation"]


def repositories(spark, sf):
    """Documents as files: the source is the project, the language a folder."""
    d = table(spark, sf, "documents", spread=True)
    return d.select(
        F.col("source").alias("project"), F.concat_ws("/", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("text").alias("content"), "doc_id", "lang",
    )


LINES = """
WITH f AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
"""


@query(
    "k01_find_names",
    LINES
    + r"""SELECT doc_id, n::BIGINT AS line, name FROM (SELECT doc_id, n, unnest(regexp_extract_all(line, '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS name FROM f)
          WHERE name IN ('the', 'un', 'der', 'que', 'ation')""",
)
def k01(spark, sf):
    return k.find_names(repositories(spark, sf), ["doc_id"], "content", NAMES).select("doc_id", F.col("line").cast("long").alias("line"), "name")


@query(
    "k02_at_risk_names",
    """WITH r AS (SELECT c_custkey, c_name, 'c' || c_custkey AS concept, CASE WHEN c_mktsegment = 'BUILDING' THEN 'was `Customer#' || lpad((c_custkey // 2)::VARCHAR, 9, '0') || '(x)` before' END AS notes,
                          CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS n FROM customer)
       SELECT a.concept, b.c_name AS name, b.concept AS held_by FROM r a JOIN r b ON a.notes = 'was `' || b.c_name || '(x)` before' WHERE a.n > 0 AND a.concept <> b.concept""",
)
def k02(spark, sf):
    key = F.col("c_custkey")
    old = F.lpad(F.floor(key / 2).cast("string"), 9, "0")
    register = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), key.cast("string")).alias("concept"), F.col("c_name").alias("python"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("was `Customer#"), old, F.lit("(x)` before"))).alias("notes"),
        (F.col("c_acctbal") > 0).cast("int").alias("rename_count"),
    )
    return k.at_risk(register, "python", "was `([^`]+)`").select("concept", "name", "held_by")


def marked(spark, sf):
    """Conversations with a marker planted on a line of its own after the text; the role decides its attributes."""
    c = table(spark, sf, "conversations")
    role = F.col("role")
    tail = F.when(role == "user", " side=python").when(role == "system", ' side=typescript own_reason="kept on purpose"').otherwise("")
    ident = F.concat(F.lit("c-"), F.col("conv_id").cast("string"))
    content = F.concat("text", F.lit("\n# unavailable parity_id="), ident, tail, F.lit("\nend"))
    suffix = F.when(role == "assistant", F.when(F.col("turn") % 4 == 1, ".py").otherwise(".ts")).otherwise(".md")
    folder = F.when(F.col("conv_id") % 7 == 0, "src/dist/").otherwise("src/")
    path = F.concat(folder, F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), suffix)
    return k.find_markers(c.select("conv_id", "turn", path.alias("path"), content.alias("content")), ["conv_id", "turn"], "path", "content")


MARKERS = r"""
WITH m AS (SELECT conv_id, turn, len(string_split(text, chr(10))) + 1 AS line, 'c-' || conv_id AS parity_id,
                  CASE role WHEN 'user' THEN 'python' WHEN 'system' THEN 'typescript' ELSE CASE WHEN turn % 4 = 1 THEN 'python' ELSE 'typescript' END END AS side,
                  CASE WHEN role = 'system' THEN 'kept on purpose' END AS own_reason
           FROM conversations WHERE conv_id % 7 <> 0)
"""


@query("k03_find_markers", MARKERS + "SELECT conv_id, turn, parity_id, side, own_reason FROM m")
def k03(spark, sf):
    return marked(spark, sf).select("conv_id", "turn", "parity_id", "side", "own_reason")


def ledger(spark, sf):
    """One entry per labelled document, for both sides."""
    labels = table(spark, sf, "labels")
    sides = F.explode(F.array(F.lit("python"), F.lit("typescript"))).alias("side")
    return labels.select(F.concat(F.lit("c-"), F.col("doc_id").cast("string")).alias("parity_id"), sides, "quality", "toxic")


@query("k04_unresolved_markers", MARKERS + "SELECT conv_id, turn, parity_id FROM m WHERE parity_id NOT IN (SELECT 'c-' || doc_id FROM labels WHERE toxic = 0)")
def k04(spark, sf):
    return k.unresolved(marked(spark, sf), ledger(spark, sf).where("toxic = 0")).select("conv_id", "turn", "parity_id")


@query(
    "k05_closed_between",
    MARKERS + "SELECT conv_id, turn, parity_id FROM m JOIN labels ON parity_id = 'c-' || doc_id WHERE own_reason IS NULL AND toxic = 0 AND NOT (quality = 1 AND side = 'python')",
)
def k05(spark, sf):
    entries = ledger(spark, sf)
    status = F.when((F.col("quality") == 1) & (F.col("side") == "python"), "complete").otherwise("absent")
    before = entries.select("parity_id", "side", status.alias("status"), (F.col("toxic") == 1).alias("terminal"))
    after = entries.select("parity_id", "side", F.lit("complete").alias("status"))
    return k.closed_between(marked(spark, sf), before, after).select("conv_id", "turn", "parity_id")


def released(spark, sf):
    """Documents, unchanged, with a release written once on a line after the text, spelled by language; the Spanish ones get
    neighbours that must not count."""
    spelled = F.when(F.col("lang") == "en", "tool 26.1.0,").when(F.col("lang") == "fr", "v26-1 ok").when(F.col("lang") == "de", "x_26_1.").otherwise("pkg 0.26.1 or 26.10 on 2026-10-13")
    files = repositories(spark, sf)
    return files.withColumn("content", F.concat("content", F.lit("\n  "), spelled, F.lit("\n")))


# What is planted, where it begins after the text, and the line it stands on. No text of the tables holds this release.
PLANTED = """
WITH p AS (SELECT doc_id, source, lang, length(text) + 3 + CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 ELSE 0 END AS begin,
                  length(text) - length(replace(text, chr(10), '')) + 2 AS line,
                  CASE lang WHEN 'en' THEN '26.1.0' WHEN 'fr' THEN 'v26-1' ELSE '26_1' END AS found,
                  CASE lang WHEN 'en' THEN 'tool 26.1.0,' WHEN 'fr' THEN 'v26-1 ok' ELSE 'x_26_1.' END AS shown
           FROM documents WHERE lang <> 'es')
"""


@query("k06_release_spellings", PLANTED + "SELECT doc_id, begin, begin + length(found) AS stop, line, found, shown FROM p")
def k06(spark, sf):
    return k.occurrences(released(spark, sf), ["doc_id"], "content", k.spellings(26, 1, 0))


def declared_statements(spark, sf):
    """Every document declares one statement; German ones expect two."""
    files = repositories(spark, sf)
    pattern = F.when(F.col("lang") == "fr", r"(v\d+-\d+) ok").when(F.col("lang") == "de", r"x_(\d+_\d+)").otherwise(r"tool (\d+\.\d+\.\d+)")
    form = F.when(F.col("lang") == "fr", "dashed-line").when(F.col("lang") == "de", "underscored-line").otherwise("full")
    return files.select("doc_id", pattern.alias("pattern"), F.when(F.col("lang") == "de", 2).otherwise(1).alias("occurrences"), form.alias("form"))


STATED = PLANTED + """, s AS (
SELECT doc_id, 'missing' AS finding, NULL::BIGINT AS line, NULL AS found, NULL AS expected, NULL AS shown, source FROM documents WHERE lang IN ('de', 'es')
UNION ALL SELECT doc_id, 'stale', line, found, CASE lang WHEN 'en' THEN '26.2.0' ELSE '26-2' END, shown, source FROM p WHERE lang <> 'de')
"""


@query("k07_check_statements", STATED + "SELECT doc_id, finding, line, found, expected, shown FROM s")
def k07(spark, sf):
    return k.check_statements(released(spark, sf), ["doc_id"], "content", declared_statements(spark, sf), (26, 2, 0))


# Every "the" with the lower-case word after it, and its offset: what stands between matches, and the matches before it.
WORD_SPANS = r"""
WITH t AS (SELECT doc_id, text, string_split_regex(text, '\bthe\b(?: [a-z]+)?') AS parts, regexp_extract_all(text, '\bthe\b(?: [a-z]+)?') AS ms FROM documents WHERE lang <> 'es'),
w AS (SELECT doc_id, text, m, (sum(length(part) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS begin
      FROM (SELECT doc_id, text, unnest(parts[:len(ms)]) AS part, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM t)),
d AS (SELECT doc_id, begin, length(left(text, begin)) - length(replace(left(text, begin), chr(10), '')) + 1 AS line FROM w WHERE m = 'the')
"""


@query("k08_strangers", WORD_SPANS + "SELECT doc_id, begin, begin + 3 AS stop, line FROM d")
def k08(spark, sf):
    # Declared: "the" with a lower-case word after it. Left: "the" before anything else.
    files = repositories(spark, sf)
    declared = files.select("project", "path", F.lit(r"\bthe\b [a-z]+").alias("pattern"))
    found = k.stranger_occurrences(files, ["project", "path"], "path", "content", r"\bthe\b", declared, ["es/**"], [])
    return found.select(F.regexp_extract("path", r"d(\d+)\.txt$", 1).cast("long").alias("doc_id"), "begin", "stop", "line")


@query(
    "k09_glob_match",
    r"""SELECT page_id, regexp_full_match(p, '(.*/)?[a-z]{2}/[0-9]+') AS numbered, regexp_full_match(p, '[^/]*\.example\.com/.*') AS com, regexp_full_match(p, '.*/[^/]*\.html') AS html
       FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages)""",
)
def k09(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    numbered = path.rlike(glob_regex("**/??/*")) & path.rlike(r"/[a-z]{2}/[0-9]+$")
    return table(spark, sf, "pages").select(
        "page_id", numbered.alias("numbered"), path.rlike(glob_regex("*.example.com/**")).alias("com"), path.rlike(glob_regex("**/*.html")).alias("html")
    )


@query("k10_missing_declared", "SELECT p_partkey FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')")
def k10(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    declared = p.select("p_partkey", F.concat(F.lit("data/"), key, F.when(F.col("p_type") == "SMALL", "/*.csv").otherwise(".csv")).alias("path"))
    present = p.where("p_type = 'PROMO'").select(F.concat(F.lit("data/"), key, F.lit(".csv")).alias("path"))
    return k.missing_declared(declared, present, ["path"]).select("p_partkey")


@query(
    "k11_lagging_projects",
    STATED + "SELECT doc_id, finding, line FROM s WHERE source NOT IN ('src1', 'src2')",
)
def k11(spark, sf):
    files = repositories(spark, sf)
    lagging = spark.sql("SELECT * FROM VALUES ('src1'), ('src2') AS t(project)")
    declared = k.without_lagging(declared_statements(spark, sf).join(files.select("doc_id", "project"), "doc_id"), lagging, "project").drop("project")
    return k.check_statements(released(spark, sf), ["doc_id"], "content", declared, (26, 2, 0)).select("doc_id", "finding", "line")


@query(
    "k12_stranger_summary",
    """SELECT source AS project, lang AS folder, count(*) AS occurrences FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY ALL""",
)
def k12(spark, sf):
    files = released(spark, sf)
    none = files.select("project", "path", F.lit("no such text").alias("pattern"))
    found = k.stranger_occurrences(files, ["project", "path"], "path", "content", k.spellings(26, 1, 0), none)
    return k.stranger_summary(found, "project", "path")


@query(
    "k13_line_of",
    LINES + r", m AS (SELECT doc_id, n, line, unnest(regexp_extract_all(line, '\bder\b')) AS found FROM f) SELECT doc_id, found, n::BIGINT AS line, left(regexp_replace(line, '^\s+|\s+$', '', 'g'), 200) AS shown FROM m",
)
def k13(spark, sf):
    return k.occurrences(repositories(spark, sf), ["doc_id"], "content", r"\bder\b").select("doc_id", "found", "line", "shown")


VERSIONS_TEXT = "p_size % 9 || '.' || p_partkey % 4 || '.0'"


@query("k14_supported_set", f"SELECT version, row_number() OVER (ORDER BY a, b) AS place FROM (SELECT DISTINCT {VERSIONS_TEXT} AS version, p_size % 9 AS a, p_partkey % 4 AS b FROM part)")
def k14(spark, sf):
    releases = k.supported(part_releases(spark, sf), "content", r'release = "(\d+\.\d+\.\d+)"')
    # The order is the result; few releases are left after the distinct, one partition holds them.
    return releases.coalesce(1).select("version", (F.monotonically_increasing_id() + 1).alias("place"))


def part_releases(spark, sf):
    version = F.concat((F.col("p_size") % 9).cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string"), F.lit(".0"))
    return table(spark, sf, "part").select(F.concat(F.lit('# set\nrelease = "'), version, F.lit('"\n')).alias("content"))


@query(
    "k14_supported_summary",
    f"SELECT arg_max(version, a * 10 + b) AS newest, count(*) AS releases FROM (SELECT DISTINCT {VERSIONS_TEXT} AS version, p_size % 9 AS a, p_partkey % 4 AS b FROM part)",
)
def k14_summary(spark, sf):
    return k.supported_summary(k.supported(part_releases(spark, sf), "content", r'release = "(\d+\.\d+\.\d+)"'))
