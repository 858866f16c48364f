"""Exact top-k search by inner product with a three-phase uniform threshold over blocks of components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import batch_of, durable, written

#: Queries broadcast at once, candidates scored at once by a task.
QUERY_BLOCK, ROW_BLOCK = 4_096, 2_048


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, vector): components as floor(scale * x). Vectors that are null, or hold a null or non-finite component, are left out."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), whole.cast("array<bigint>").alias("vector"))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


class Queries:
    """A block of query vectors of one length, cut into the components of each node."""

    def __init__(self, ids: list[int], vectors: list[list[int]], nodes: int) -> None:
        self.ids, self.whole = np.array(ids, np.int64), np.array(vectors, np.int64).reshape(len(ids), len(vectors[0]))
        width = self.whole.shape[1]
        self.cuts = [(width * i // nodes, width * (i + 1) // nodes) for i in range(nodes)]

    def partial(self, node: int, rows: np.ndarray) -> np.ndarray:
        """Scores of one node: queries by rows. Doubles where they are exact, whole numbers otherwise."""
        a, b = self.cuts[node]
        q, r = self.whole[:, a:b], rows[:, a:b]
        most = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(b - a, 1)
        if most < 2**53:
            return (q.astype(np.float64) @ r.T.astype(np.float64)).astype(np.int64)
        return q @ r.T


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most ROW_BLOCK candidates of the queries' width."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(at, ROW_BLOCK)
            ids, lists = part.column(0).to_numpy(), part.column(1)
            right = np.diff(lists.offsets.to_numpy()) == width
            if right.all():
                rows = lists.flatten().to_numpy().reshape(len(ids), width)
            else:
                ids = ids[right]
                rows = np.array([x for x, ok in zip(lists.to_pylist(), right) if ok], np.int64).reshape(len(ids), width)
            if len(ids):
                yield ids, rows


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, nodes: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query with all other rows, ties to smaller ids.

    A node is a block of components; a score is the sum of its nodes' partial scores.

    1. Each node gathers, for every query, its own k best candidates (of each block of rows, then of all). Their whole
       scores are looked up; the k-th best, t, is a score that k candidates reach, so no winner is below it.
    2. The cutoff goes out: a candidate of score t or more has at least t / nodes in some node. Each node returns what
       reaches that, unless even the best of the other nodes could not lift it to t.
    3. The returned candidates' whole scores are looked up, and the k best of each query are its result. All winners are
       among them, whatever the signs.

    Queries are a stated set, broadcast in blocks of QUERY_BLOCK against all rows. Equal vectors are one candidate with
    the k + 1 smallest ids: no other of them can be in a result. Vectors of another length than the query are no
    candidates of it. Rows whose vector is null, or has a null or non-finite component, take no part, nor do rows without
    id. Rows that repeat an id with one vector count once, with other vectors each; never for a query of their own id. A query with fewer candidates
    gets them all; an empty table gives an empty table. Other columns are not read. Scores must fit 64 bits.
    """
    usable = whole_vectors(vectors, id_col, vector_col, scale)
    queries = written(whole_vectors(vectors.where(is_query), id_col, vector_col, scale).distinct())
    firsts = Window.partitionBy("vector").orderBy("vec_id")
    few = usable.distinct().withColumn("n", F.row_number().over(firsts)).where(F.col("n") <= k + 1)  # cut in each task before it moves
    groups = written(few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "vector", "ids"))

    sizes = queries.groupBy(F.size("vector").alias("width")).count().collect()
    spark, results = vectors.sparkSession, []
    for row in sorted(sizes):
        parts = -(-row["count"] // QUERY_BLOCK)
        for i in range(parts):
            mine = queries.where((F.size("vector") == row.width) & (F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)) == i))
            got = sorted(mine.collect(), key=lambda r: (r.vec_id, r.vector))
            results.append(_block(spark, groups, mine, Queries([r.vec_id for r in got], [r.vector for r in got], nodes), row.width, k, nodes))
    if not results:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    return out


def _block(spark, groups: DataFrame, mine: DataFrame, block: Queries, width: int, k: int, nodes: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(block)
    # Equal vectors stand for up to k + 1 ids, of which the query's own is none of its candidates.
    most = k + 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for ids, rows in blocks_of(batches, width):
            for node in range(nodes):
                scores = block.partial(node, rows)
                n = min(most, len(ids))
                top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                query = np.repeat(np.arange(len(block.ids)), n)
                yield batch_of(query=query, node=np.full(len(query), node, np.int32), rep=ids[top].reshape(-1), part=np.take_along_axis(scores, top, 1).reshape(-1))

    lists = groups.select("rep", "vector").mapInArrow(gather, "query long, node int, rep long, part long")
    best = Window.partitionBy("query", "node").orderBy(F.desc("part"), "rep")
    local = durable(lists.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).drop("n"))

    numbered = spark.createDataFrame([(i, int(x)) for i, x in enumerate(block.ids)], "query long, query_id long")
    vectors = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(block.whole)], "query long, of array<bigint>") if width else spark.createDataFrame([(i, []) for i in range(len(block.ids))], "query long, of array<bigint>")
    asked = F.broadcast(durable(numbered.join(vectors, "query")))

    def resolved(pairs: DataFrame) -> DataFrame:
        """(query, query_id, vec_id, score) of (query, rep): the whole score, for each id of the candidate but the query's own."""
        rows = pairs.join(groups.where(F.size("vector") == width), "rep").join(asked, "query")
        rows = rows.select("query", "query_id", F.explode("ids").alias("vec_id"), inner(F.col("of"), F.col("vector")).alias("score"))
        return rows.where("vec_id <> query_id").distinct()

    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    seen = resolved(local.select("query", "rep").distinct()).withColumn("rank", F.row_number().over(by_score))
    reached = {r.query: r.score for r in seen.where(F.col("rank") == k).select("query", "score").collect()}
    peaks = {(r.query, r.node): r.peak for r in local.groupBy("query", "node").agg(F.max("part").alias("peak")).collect()}
    n = len(block.ids)
    low = -(2**62)
    cutoff = np.array([reached.get(i, low) for i in range(n)], np.int64)
    peak = np.array([[peaks.get((i, j), low) for j in range(nodes)] for i in range(n)], np.int64).reshape(n, nodes)
    safe = spark.sparkContext.broadcast((cutoff, peak))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (cutoff, peak) = shared.value, safe.value
        every = cutoff == low  # fewer than k candidates are known: all are sent
        for ids, rows in blocks_of(batches, width):
            hit = np.zeros((n, len(ids)), bool)
            for node in range(nodes):
                scores = block.partial(node, rows)
                others = peak.sum(1) - peak[:, node]
                enough = (scores * nodes >= cutoff[:, None]) & (scores + others[:, None] >= cutoff[:, None])
                hit |= enough | every[:, None]
            query, at = np.nonzero(hit)
            if len(query):
                yield batch_of(query=query, rep=ids[at])

    sent = groups.select("rep", "vector").mapInArrow(collect, "query long, rep long")
    final = resolved(sent).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
