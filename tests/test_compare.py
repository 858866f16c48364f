"""Typed comparison: golden rows and brute-force twins on small data."""

import json
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.functions.json_batch import plain_trees, slices
from concord.functions.json_text import FIELDS, NameHash, tree
from concord.functions.numbers import num_equal, read_number
from concord.operators import compare as c
from concord.operators.drift import text_drift
from concord.operators.nodes import json_nodes, json_rejects

NAN = float("nan")


@pytest.mark.parametrize(
    "a, b, plain, sweep",
    [
        (3.0, 3.0, True, True),
        (0.0, 1e-300, False, False),
        (1.0, 1 + 1e-13, True, True),
        (1.0, 1 + 1e-11, False, False),
        (NAN, NAN, False, True),
        (math.inf, math.inf, False, True),
        (math.inf, 1.0, False, False),
        (0.0, -0.0, True, True),
    ],
)
def test_number_rules(spark, a, b, plain, sweep):
    row = spark.createDataFrame([(a, b)], "a double, b double").select(
        num_equal(F.col("a"), F.col("b")).alias("p"), num_equal(F.col("a"), F.col("b"), nan_equal=True).alias("s")
    ).first()
    assert (row.p, row.s) == (plain, sweep)


def test_number_texts(spark):
    texts = ["3", " 3.0 ", "1e3", ".5", "1d", "0x1", "", "Autosize", "1.", "-2E-1"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(read_number(F.col("t"))).collect()]
    assert got == [3.0, 3.0, 1000.0, 0.5, None, None, None, None, 1.0, -0.2]


def diff(left, right, path="", out=None):
    """The rules, written for one pair of values."""
    out = [] if out is None else out
    kind = lambda v: "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
    step = lambda k: path + "/" + str(k).replace("~", "~0").replace("/", "~1")
    if kind(left) != kind(right):
        out.append((path, "type"))
    elif kind(left) == "object":
        for k in left:
            if k in right:
                diff(left[k], right[k], step(k), out)
            else:
                out.append((step(k), "extra"))
        out.extend((step(k), "missing") for k in right if k not in left)
    elif kind(left) == "array":
        if len(left) != len(right):
            out.append((path, "length"))
        for i in range(min(len(left), len(right))):
            diff(left[i], right[i], step(i), out)
    elif left != right:
        out.append((path, "value"))
    return out


def some_value(rng, depth):
    roll = rng.random()
    if depth == 0 or roll < 0.4:
        return rng.choice([1, 2, "1", "x", True, None])
    if roll < 0.75:
        return {k: some_value(rng, depth - 1) for k in rng.sample(["0", "1", "a/b", "~", "k"], rng.randint(0, 3))}
    return [some_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]


def test_nested_differences_against_brute_force(spark):
    rng = random.Random(7)
    pairs = [(i, some_value(rng, 3), some_value(rng, 3)) for i in range(300)]
    pairs.append((300, {"a": {"0": {"x": 1}}}, {"a": [{"y": 2}]}))  # a clash with alike members beneath it
    pairs.append((301, {"a": {"0": {"x": {"q": 1}}}}, {"a": [{"x": {}}]}))
    docs = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs], "id int, a string, b string")
    left, right = (json_nodes(docs.select("id", F.col(s).alias("j")), ["id"], "j") for s in "ab")
    got = Counter((r.id, r.ptr, r.kind) for r in c.diff_nodes(left, right, ["id"]).collect())
    want = Counter((i, ptr, kind) for i, a, b in pairs for ptr, kind in diff(a, b))
    assert got == want


def test_difference_order_follows_the_left_document(spark):
    docs = spark.createDataFrame([(1, '{"z":1,"a":{"q":1},"m":[1,2]}', '{"b":0,"m":[1,3],"a":{"q":2,"c":1},"z":2,"B":0}')], "id int, a string, b string")
    left, right = (json_nodes(docs.select("id", F.col(s).alias("j")), ["id"], "j") for s in "ab")
    ordered = c.order_diffs(c.diff_nodes(left, right, ["id"]), ["id"])
    assert [r.ptr for r in ordered.collect()] == ["/z", "/a/q", "/a/c", "/m/1", "/B", "/b"]


def test_nodes_keep_document_order_and_reject_what_is_no_json(spark):
    docs = spark.createDataFrame([(1, '{"z":{"y":1,"a":2},"b":[true,null]}'), (2, "{bad"), (3, '"text"')], "id int, j string")
    rows = json_nodes(docs, ["id"], "j").where("id = 1").orderBy("ord").collect()
    assert [(r.ptr, r.jtype) for r in rows] == [
        ("", "object"), ("/z", "object"), ("/z/y", "number"), ("/z/a", "number"), ("/b", "array"), ("/b/0", "boolean"), ("/b/1", "null"),
    ]
    assert [tuple(r) for r in json_rejects(docs, ["id"], "j").collect()] == [(2, "unexpected text", 1)]
    assert {r.id for r in json_nodes(docs, ["id"], "j").collect()} == {1, 3}


def test_deep_values_are_rows_or_rejects(spark):
    docs = spark.createDataFrame([(n, "[" * n + '{"a":1}' + "]" * n) for n in (1, 39, 40, 5_000)], "id int, j string")
    assert {r.id: r["max(depth)"] for r in json_nodes(docs, ["id"], "j", 40).groupBy("id").agg({"depth": "max"}).collect()} == {1: 2, 39: 40}
    assert {tuple(r) for r in json_rejects(docs, ["id"], "j", 40).collect()} == {(40, "nested too deep", 45), (5_000, "nested too deep", 41)}
    assert {tuple(r) for r in json_rejects(docs, ["id"], "j").collect()} == {(5_000, "nested too deep", 1_001)}


def test_texts_are_read_as_the_grammar_says():
    rng, hashes = random.Random(5), NameHash()

    def strict(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    def no_constant(_):
        raise ValueError

    for _ in range(1500):
        letters = list(json.dumps(some_value(rng, 4), indent=rng.choice([None, 1])))
        for _ in range(rng.randint(0, 2)):
            letters[rng.randrange(len(letters))] = rng.choice(["", *'{}[],:"1t- \\'])
        text = "".join(letters)
        try:
            json.loads(text, object_pairs_hook=strict, parse_constant=no_constant)
            good = True
        except ValueError:
            good = False
        out = [[] for _ in FIELDS]
        reason, _ = tree(text, 50, hashes, out)
        assert good == (reason is None) == bool(out[0]), text
        assert out[2] == sorted(out[2]) and len({len(c) for c in out}) == 1
    text = '{"a":"\\ud83d\\ude00\\ud800","b":[1e2,{}]}'
    out = [[] for _ in FIELDS]
    assert tree(text, 9, hashes, out) == (None, 0)
    node = dict(zip(FIELDS, out))
    assert node["str"][1] == "\U0001f600\ufffd" and node["num"][3] == 100.0
    assert [x for x in zip(node["ord"], node["stop"]) if x[1]] == [(0, len(text) - 1), (30, len(text) - 2), (35, 36)]


def test_many_texts_are_read_as_each_one_is():
    rng, hashes = random.Random(6), NameHash()
    words = ["1", "-0", "1e400", "-1.25E-3", "12345678901234567890", "true", "null", '"x"', '"\u00e9\u20ac\U0001f600"', '""', '"a,{}[]:"', '"\\u0041"', "01", "tru", '"\x01"', "1 2"]

    def text(depth):
        space = rng.choice(["", "", " ", "\n\t"])
        kind = rng.random() if depth else 1
        parts = [space + text(depth - 1) for _ in range(rng.randrange(4))] if kind < 0.6 else []
        if kind < 0.3:
            return "[" + ",".join(parts) + space + "]"
        if kind < 0.6:
            return "{" + ",".join(f'"{rng.choice(["a", "b", "c/d", "~", "é", ""])}"{space}:{p}' for p in parts) + "}"
        return rng.choice(words[: rng.choice([12, 12, 12, 16])])

    texts = [None, "", " ", "[" * 70 + "]" * 70, "[", "]", "{]", "1,2", '{"a"}', '{"a":1,}', "[,1]"]
    for _ in range(2000):
        letters = list(text(4))
        if rng.random() < 0.3:
            letters[rng.randrange(len(letters))] = rng.choice(["", *'{}[],:"1t '])
        texts.append("".join(letters))
    for most_depth in (1000, 2):
        of, columns, left = plain_trees(pa.array(["skipped", *texts]).slice(1), most_depth, hashes)
        got = {i: [] for i in of.tolist()}
        for i, *row in zip(of.tolist(), *[c.to_pylist() for c in columns]):
            got[i].append(tuple(row))
        for i, one in enumerate(texts):
            out = [[] for _ in FIELDS]
            if tree(one, most_depth, hashes, out)[0] is None and i in got:
                assert repr(got[i]) == repr(list(zip(*out))), one
            else:
                assert i not in got, one
        assert sorted([*got, *left.tolist()]) == list(range(len(texts)))
    assert len(got) > 400
    assert list(slices(pa.array(["a" * 5, None, "", "b" * 9, "c"]), 4)) == [(0, 1), (1, 4), (4, 5)] and list(slices(pa.array(["a", "b"]))) == [(0, 2)]


def test_keyed_difference_kinds_and_duplicate_keys(spark):
    left = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 1.0, "c")], "k int, n double, s string")
    right = spark.createDataFrame([(1, 1.0, "A"), (2, 2.0, "b"), (4, 1.0, "d")], "k int, n double, s string")
    got = {(r.k, r.field, r.kind) for r in c.diff(left, right, ["k"], ["n", "s"]).collect()}
    assert got == {(1, "s", "value"), (2, "n", "type"), (3, None, "extra"), (4, None, "missing")}
    with pytest.raises(Exception, match="met twice"):
        c.diff(left.union(left), right, ["k"], ["n", "s"]).collect()


def test_bag_difference(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("n", NAN)], "s string, x double")
    right = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1)], "s string, x int").unionByName(
        spark.createDataFrame([("n", NAN)], "s string, x double")
    )
    got = sorted((r.side, r.s, r.n) for r in c.multiset_diff(left, right, ["s", "x"]).collect())
    assert got == [("left", "a", 1), ("left", "n", 1), ("right", "b", 1), ("right", "n", 1)]


def test_bag_difference_agrees_with_except_all(spark):
    rng = random.Random(3)
    make = lambda: spark.createDataFrame([(rng.randint(0, 4), rng.choice("abc")) for _ in range(200)], "x int, s string")
    left, right = make(), make()
    bag = c.expand_bag(c.multiset_diff(left, right, ["x", "s"]), chunk=3)
    got = Counter((r.side, int(r.x), r.s) for r in bag.collect())
    want = Counter([("left", r.x, r.s) for r in left.exceptAll(right).collect()] + [("right", r.x, r.s) for r in right.exceptAll(left).collect()])
    assert got == want


def regions(left, right):
    """Regions of two texts, walked character by character."""
    if left == right:
        return []
    p = 0
    while p < min(len(left), len(right)) and left[p] == right[p]:
        p += 1
    x = 0
    while x < min(len(left), len(right)) - p and left[-1 - x] == right[-1 - x]:
        x += 1
    a, b = left[p : len(left) - x], right[p : len(right) - x]
    if len(a) != len(b):
        return [(p, a, b)]
    spots = [i for i in range(len(a)) if a[i] != b[i]]
    groups = [[spots[0]]]
    for s in spots[1:]:
        if s - groups[-1][-1] - 1 >= 8:
            groups.append([s])
        else:
            groups[-1].append(s)
    return [(p + g[0], a[g[0] : g[-1] + 1], b[g[0] : g[-1] + 1]) for g in groups]


def test_text_drift_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [("", "x"), ("x", ""), ("same", "same"), ("abc\n", "abc"), ("aXa", "aXXa"), ("3.000", "3.0"), ("é𝄞b", "é𝄞c")]
    for _ in range(200):
        text = [rng.choice("ab\n") for _ in range(rng.randint(0, 40))]
        other = [rng.choice("xy") if rng.random() < 0.1 else ch for ch in text]
        if rng.random() < 0.3:
            other.insert(rng.randint(0, len(other)), "+")
        pairs.append(("".join(text), "".join(other)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    got = sorted((r.id, r.offset, r.left_text, r.right_text, r.line, r.column) for r in text_drift(df, ["id"], "a", "b").collect())
    want = sorted(
        (i, off, x, y, a[:off].count("\n") + 1, off - (a.rfind("\n", 0, off) + 1) + 1) for i, (a, b) in enumerate(pairs) for off, x, y in regions(a, b)
    )
    assert got == want


def test_drift_outside_spans_maps_offsets_back(spark):
    df = spark.createDataFrame([(1, "aa[XX]bbQccc", "aa[Y]bbRccc")], "id int, a string, b string").withColumns(
        {"sa": F.array(F.struct(F.lit(2).alias("start"), F.lit(6).alias("end"))), "sb": F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end")))}
    )
    rows = text_drift(df, ["id"], "a", "b", "sa", "sb").collect()
    assert [(r.offset, r.right_offset, r.left_text, r.right_text) for r in rows] == [(8, 7, "Q", "R")]


def test_merge_spans(spark):
    spans = [("d", 0, 5), ("d", 5, 7), ("d", 9, 9), ("d", 8, 12), ("d", 50, 99), ("d", 10, 11), ("e", -3, 2)]
    df = spark.createDataFrame([(*s, 60) for s in spans], "k string, a int, b int, n int")
    for width in (1, 4, 1000):
        got = sorted((r.k, r.a, r.b) for r in c.merge_spans(df, ["k"], "a", "b", "n", width).collect())
        assert got == [("d", 0, 7), ("d", 8, 12), ("d", 50, 60), ("e", 0, 2)]


def test_drift_of_long_texts_and_of_nulls(spark):
    long = "é7 chars\n" * 2_000_000  # 18 million characters
    one = long[:9_000_000] + "X" + long[9_000_001:]
    rows = [(1, long, one), (2, long, long[:-1]), (3, None, "new"), (4, "old", None), (5, None, None), (6, "a" * 256 + "b", "a" * 256), (7, "", "x" * 600), (8, "é" * 300 + "x" + "é" * 300, "é" * 300 + "yz" + "é" * 300)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r.id: (r.offset, r.line, r.column, r.right_offset, r.left_text, r.right_text) for r in text_drift(df, ["id"], "a", "b").collect()}
    assert got == {
        1: (9_000_000, 1_000_001, 1, 9_000_000, "é", "X"), 2: (17_999_999, 2_000_000, 9, 17_999_999, "\n", ""), 3: (0, 1, 1, 0, None, "new"), 4: (0, 1, 1, 0, "old", None),
        6: (256, 1, 257, 256, "b", ""), 7: (0, 1, 1, 0, "", "x" * 600), 8: (300, 1, 301, 300, "x", "yz"),
    }
