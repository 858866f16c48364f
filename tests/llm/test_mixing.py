import hashlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from concord.llm import mixing
from concord.llm.mixing import mix

SCHEMA = "doc_id long, text string, source string, size string, taken string, place string, target string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def brute(rows, weights=(5, 2, 1), cap=3):
    """(doc_id, size, source_size, target, taken) by sorting and by exact fractions."""
    size = lambda t: len((t or "").encode().split())
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    place = lambda i, t: int(md5(("null" if i is None else str(i)) + ":" + md5(t or ""))[:12], 16)
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: weights[n % len(weights)] for n, s in enumerate(sources)}
    full: set = set()
    while True:
        rest = sum(total.values()) - sum(cap * total[s] for s in full)
        share = sum(weight[s] for s in sources if s not in full)
        target = {s: Fraction(cap * total[s]) if s in full else Fraction(rest * weight[s], share) for s in sources}
        more = {s for s in sources if target[s] >= cap * total[s] and s not in full}
        if not more or len(full | more) == len(sources):
            break
        full |= more
    out = []
    for s in sources:
        mine = sorted(((place(i, t), i, size(t)) for i, t, x in rows if x == s), key=lambda m: (m[0], m[2]))
        budget = int(target[s] + Fraction(1, 2))
        whole, left = divmod(budget, total[s]) if total[s] else (0, 0)
        at = 0
        while at < len(mine):
            tied = [m for m in mine if m[0] == mine[at][0]]
            held = sum(m[2] for m in tied)
            carry = Fraction(0)
            for _, i, n in tied:
                exact = carry + (n if held <= left else Fraction(n * left, held) if left > 0 else 0)
                once, carry = int(exact), exact - int(exact)
                out.append((i, n, total[s], round(float(target[s]), 6), whole * n + once))
            left -= held
            at += len(tied)
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def corpus():
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 5}") for i in range(200)]
    return rows + [(1000 + i, "w " * 3, "tiny") for i in range(4)] + [(2000, "w " * 900, "Ω"), (2001, "a b", None), (2002, "c", None)]


def test_same_as_sorting(spark):
    rows = corpus()
    found = got(mix(table(spark, rows)))
    assert found == brute(rows) == got(mix(table(spark, rows).repartition(5)))
    taken, targets = {}, {}
    for i, s in [(r[0], r[2]) for r in rows]:
        taken[s] = taken.get(s, 0) + next(x[4] for x in found if x[0] == i)
        targets[s] = next(x[3] for x in found if x[0] == i)
    assert all(abs(taken[s] - targets[s]) <= 1 for s in taken)
    assert all(x[4] <= 3 * x[1] for x in found)


def test_ties_and_joins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(1, "a b c", "x")] * 5 + [(2, "a b", "x"), (3, "a " * 50, "y"), (4, "b", "z"), (None, "q q", "z")]
    assert got(mix(table(spark, rows))) == brute(rows)


def test_hard_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t", None), (4, "one two", "c"), (5, "x " * 20_000, "c")]
    assert got(mix(table(spark, rows))) == brute(rows)
    assert got(mix(table(spark, [(1, None, "a"), (2, "", "b")]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert got(mix(table(spark, []))) == []


def test_thresholds_are_nested(spark):
    """A document taken at a small target is taken at a larger one."""
    rows = [(i, "w " * 5, "ab"[i % 2]) for i in range(300)]
    small = {r.doc_id for r in mix(table(spark, rows), weights=(1, 3)).where(F.col("source") == "a").where("taken > 0").collect()}
    large = {r.doc_id for r in mix(table(spark, rows), weights=(2, 3)).where(F.col("source") == "a").where("taken > 0").collect()}
    assert small < large


@pytest.mark.parametrize("rows", [corpus()])
def test_kept_columns(spark, rows):
    df = table(spark, rows)
    kept = mix(df, keep=True)
    assert set(df.columns) <= set(kept.columns) and len(kept.columns) == len(set(kept.columns))
    assert got(kept) == got(mix(df))


@pytest.mark.parametrize("key", [None, 7])
def test_repeated_rows_reach_their_target(spark, key):
    """A source that is one row over and over, without an id or with one id, takes its target to the word."""
    rows = [(key, "w", "a")] * 1000 + [(i, "w", "b") for i in range(1000)]
    found = mix(table(spark, rows).repartition(6))
    sums = {r.source: (r.target, r.taken) for r in found.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert all(abs(taken - target) < 1 for target, taken in sums.values())
    assert got(found) == brute(rows) and found.count() == len(rows)


def test_columns_that_clash_in_another_case(spark):
    df = table(spark, corpus()).withColumnRenamed("size", "SIZE").withColumnRenamed("taken", "Taken")
    kept = mix(df, keep=True)
    assert sorted(c.lower() for c in kept.columns) == sorted({c.lower() for c in kept.columns})
    assert got(kept.select("doc_id", "size", "source_size", "target", "taken")) == got(mix(df))
