"""The numbered operators over the driver's tables, with production parameters and, where SQL can say it, the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import collocations, decontaminate, languages, licences, mixing, near, pii, quality, scoring, spellings, substring, tokens, topk
from concord.llm.common import modest_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only here: the other queries do without the vocabulary files

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op6_mixing"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS place
  FROM documents),
s AS MATERIALIZED (
  SELECT source, source_size, 3 * source_size AS most,
    CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
levels(step, level) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE / sum(weight)::DOUBLE FROM s)
  UNION ALL
  SELECT step + 1, coalesce((SELECT (sum(source_size) - coalesce(sum(most) FILTER (WHERE most <= level * weight), 0))::DOUBLE
      / nullif(sum(weight) FILTER (WHERE most > level * weight), 0)::DOUBLE FROM s), level)
  FROM levels WHERE step < 40),
t AS (
  SELECT source, source_size, least(most::DOUBLE, level * weight) AS target
  FROM s, (SELECT level FROM levels WHERE step = 40)),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT *, (floor(target + 0.5) - whole * source_size)::BIGINT AS rest FROM b),
c AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY place, size ROWS UNBOUNDED PRECEDING))::HUGEINT AS until,
    (sum(size) OVER (PARTITION BY source, place))::HUGEINT AS total,
    (sum(size) OVER (PARTITION BY source, place ORDER BY size ROWS UNBOUNDED PRECEDING))::HUGEINT AS part FROM d),
f AS (SELECT c.*, r.* EXCLUDE (source), c.until - c.part AS start FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (whole * size + CASE WHEN start + total <= rest THEN size
    WHEN start < rest THEN part * (rest - start) // total - (part - size) * (rest - start) // total ELSE 0 END)::BIGINT AS taken
FROM f
"""


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


ORACLES["op3_license_scan"] = licences.scan_sql()


@query
def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a fixed one so that runs can be compared; a user passes their own."""
    return pii.surrogates(table(spark, sf_dir, "documents"), b"example key").select("doc_id", "text", "n_entities", "kinds")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLES["op9_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bn),
dn AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT dn.doc_id, dn.i, dn.n, bn.item_id FROM dn JOIN bn USING (n, key)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op8_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT key, min(doc_id) AS first FROM e GROUP BY key),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM e JOIN f USING (key) WHERE doc_id > first),
g AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM r GROUP BY doc_id),
t AS (SELECT doc_id, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, word, p FROM t ANTI JOIN r USING (doc_id, p)) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op2_top_k"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(table(spark, sf_dir, "documents"))


def held_out_language() -> Column:
    """The documents whose languages are not learnt; null for a null id, of which nothing is learnt either."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@query
def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.predicted(table(spark, sf_dir, "documents"), held_out_language())


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
o AS (SELECT lang, s, w[i:i + s - 1] AS w FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS sizes(s) WHERE len(w) >= s)),
f AS MATERIALIZED (SELECT lang, s, array_to_string(w, ' ') AS phrase, any_value(w) AS w, count(*) AS n FROM o GROUP BY 1, 2, 3),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE s = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE s > 1 AND n >= 10),
i AS (SELECT lang, phrase, max(n) AS most FROM (SELECT lang, n, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE s = 3) GROUP BY ALL),
k AS (SELECT lang, phrase, n AS a, cut, array_to_string(w[1:cut], ' ') AS l, array_to_string(w[cut + 1:], ' ') AS r FROM (SELECT *, unnest(range(1, s)) AS cut FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.cut, l.n AS l, r.n AS r, ((1000000::HUGEINT * k.a * k.a) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.l JOIN f r ON r.lang = k.lang AND r.phrase = k.r),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s),
x AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase COLLATE "C") AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE best = 1 AND (most IS NULL OR 100 * most < 50 * a))
SELECT x.lang, rank, phrase, a, l, r, t.n, score FROM x JOIN t ON t.lang = x.lang WHERE rank <= 2000
"""


@query
def op13_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spellings(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
