"""Skew-proof joins and running values give what the plain operators give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from concord.operators import skew
from concord.operators.compare import merge_spans
from concord.operators.skew import blocked_number, blocked_running, data_blocks, first_members, hot_keys, lookup_join, spread_join


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)
    rows = [(i, 7 if rng.random() < 0.4 else rng.choice([None, *range(5000)])) for i in range(6000)]
    fact = spark.createDataFrame(rows, "id int, k int")
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(0, 5000, 2)] + [(7, "hot")], "k int, d string")
    return fact, dim


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_is_the_plain_join(sides, how):
    fact, dim = sides
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spread_join(fact, dim, ["k"], how)) == key(fact.join(dim, ["k"], how))


def test_equal_rows_and_maps_can_be_spread(spark):
    fact = spark.createDataFrame([(1, {"a": 1})] * 50 + [(None, {})], "k int, m map<string,int>")
    dim = spark.createDataFrame([(1, "d")], "k int, d string")
    assert sorted(map(str, spread_join(fact, dim, ["k"]).select("k", "d").collect())) == ["Row(k=1, d='d')"] * 50 + ["Row(k=None, d=None)"]


def test_hot_keys_are_few_and_hot(sides):
    fact, _ = sides
    assert [r.k for r in hot_keys(fact.where("k IS NOT NULL"), ["k"]).collect() if r.k == 7] == [7]
    assert hot_keys(fact, ["k"]).count() < skew.HOT_SHARE


def test_lookup_join_works_on_both_sides_of_its_bound(sides, monkeypatch):
    fact, dim = sides
    small = sorted(map(str, lookup_join(fact, dim, ["k"]).collect()))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    assert sorted(map(str, lookup_join(fact, dim, ["k"]).collect())) == small


@pytest.mark.parametrize("width", [1, 10, 10_000])
def test_running_values_against_plain_windows(spark, width):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randint(-5, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = blocked_running(
        df, ["g"], [F.col("o")], F.floor(F.col("o") / width),
        {"s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False), "n": ("min", F.col("v"), True)},
    )
    w = Window.partitionBy("g").orderBy("o")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("g", "o", "v", F.sum("v").over(upto).alias("s"), F.max("v").over(before).alias("m"), F.min("v").over(upto).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_numbers_without_a_group(spark):
    df = spark.range(100).select((F.col("id") * 3).cast("int").alias("o"))
    assert [r.n for r in blocked_number(df, [], "o", "n", rows=20).orderBy("o").collect()] == list(range(1, 101))


def test_first_members(spark):
    df = spark.createDataFrame([("g", x) for x in "dbaabc"] + [("h", "z")], "g string, m string")
    assert {r.g: r.first for r in first_members(df, ["g"], "m", 2, "first").collect()} == {"g": ["a", "b"], "h": ["z"]}


@pytest.mark.parametrize("rows", [1, 50, 10_000])
def test_blocks_follow_the_data(spark, rows):
    """Sparse 64-bit values, a group of half the rows, a null group and no group at all."""
    rng = random.Random(4)
    values = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(-(2**62), 2**62)) for _ in range(800)]
    df = spark.createDataFrame(values, "g string, o long")
    for group in (["g"], []):
        w = Window.partitionBy(*group).orderBy("o")
        want = df.withColumn("n", F.row_number().over(w).cast("long"))
        assert sorted(map(str, blocked_number(df, group, "o", "n", rows=rows).collect())) == sorted(map(str, want.collect()))
    sizes = [r["count"] for r in data_blocks(df, ["g"], "o", 50).groupBy("g", "_block").count().collect()]
    assert max(sizes) <= 50


@pytest.mark.parametrize("rows", [1, 30, 10_000])
def test_merged_spans_against_going_along(spark, rows):
    rng = random.Random(6)
    spans = [(rng.choice(["hot", "hot", "b"]), s, s + rng.randrange(0, 40)) for s in (rng.randrange(3000) for _ in range(400))]
    spans += [("hot", 100, 900), ("b", 5, 5), ("b", -9, 3)]
    want = []
    for g in ("hot", "b"):
        at = None
        for s, e in sorted((max(0, min(s, 2000)), max(0, min(e, 2000))) for k, s, e in spans if k == g and e > s):
            if at is None or s > at[2]:
                at = [g, s, e]
                want.append(at)
            at[2] = max(at[2], e)
    df = spark.createDataFrame(spans, "k string, a int, b int").withColumn("len", F.lit(2000))
    got = merge_spans(df, ["k"], "a", "b", "len", rows=rows).select("k", "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_spans_are_merged_in_one_pass(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "id AS a", "id + 2 AS b").write.parquet(f"{tmp_path}/spans")
    plan = merge_spans(spark.read.parquet(f"{tmp_path}/spans"), ["k"], "a", "b", rows=10)._jdf.queryExecution().sparkPlan().toString()
    # Islands come from the windows; the only aggregations are counts, bounds, totals of blocks and the result.
    assert plan.count("FileScan") <= 6 and plan.count("max(_opens") <= 2
