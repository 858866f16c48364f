import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import topk
from concord.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", "s", "s") for i, v in rows], SCHEMA)


def brute(rows, is_query, k=10):
    whole = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in whole:
        if is_query(q):
            best = sorted({(-int(a @ b), i) for i, b in whole if i != q and len(a) == len(b)})[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("nodes", [1, 2, 5])
def test_same_as_brute_force(spark, nodes):
    draw = np.random.default_rng(nodes)
    rows = [(i, [float(x) for x in draw.standard_normal(8)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a large group of copies, all tied
    rows += [(2000 + i, [0.0] * 8) for i in range(20)]
    is_query = lambda i: i % 20 == 0
    assert got(top_k(table(spark, rows), F.col("vec_id") % 20 == 0, nodes=nodes)) == brute(rows, is_query)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 4)]) for i in range(80)]
    assert got(top_k(table(spark, rows), F.col("vec_id") % 7 == 0, k=4)) == brute(rows, lambda i: i % 7 == 0, 4)


def test_hard_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [-3e6, 2e3]), (9, [5e5, 5e5])]
    everyone = F.col("vec_id") >= 0
    assert got(top_k(table(spark, rows), everyone)) == brute(rows, lambda i: True)
    assert got(top_k(table(spark, rows), F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0)
    assert got(top_k(table(spark, []), everyone)) == set()
    assert got(top_k(table(spark, rows), F.lit(False))) == set()


def test_repeated_rows_leave_room_for_other_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(20) for _ in range(12)] + [(100, [1.0, 1.0]), (101, [0.5, 0.0])]
    assert got(top_k(table(spark, rows), F.col("vec_id") >= 100)) == brute(rows, lambda i: i >= 100)
