import random
import re

import numpy as np
import pytest

from concord.llm import decontaminate
from concord.llm.decontaminate import FMIndex, WaveletMatrix, Windows, cleaned, contamination, digest, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, items, width=10):
    out = {}
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for item, said in items:
            v = words(said)
            for a in range(max(1, len(v) - width + 1) if v else 0):
                window = v[a : a + width]
                for b in range(len(w) - len(window) + 1):
                    if w[b : b + len(window)] == window:
                        hit |= set(range(b, b + len(window)))
                        found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def corpus():
    draw = random.Random(8)
    text = lambda n: [draw.choice("abcdefgh") for _ in range(n)]
    items = [(i, " ".join(text(draw.randint(3, 30)))) for i in range(12)] + [(30, "Only Two"), (31, "été, naïve-naïve 9"), (32, None), (33, "--"), (30, "only two!")]
    rows = []
    for i in range(30):
        w = text(draw.randrange(60))
        if i % 3 == 0:
            v = items[i % 12][1].split()
            w[len(w) // 2 : len(w) // 2] = v[: draw.randint(1, len(v))]
        rows.append((i, " ".join(w)))
    rows += [(100, "then ONLY\ttwo. only--two"), (101, "ÉTÉ été naïve NAïVE 9"), (102, " ".join(["a b c"] * 500)), (103, rows[0][1])]
    return rows, items


def got(df):
    return {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in df.collect()}


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("shard, block", [(2_000_000, 200_000), (40, 17)])
def test_same_as_brute_force(spark, docs, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    rows, items = corpus()
    found = contamination(docs(rows), benchmark(spark, items), block=block)
    assert got(found) == brute(rows, items)
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_hit for r in found.collect())
    assert [c for c, _ in digest(found).dtypes] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_hard_rows(spark, docs, hard):
    items = benchmark(spark, [(1, "one"), (None, "another text"), (2, "word5 word6 word7")])
    rows = contamination(docs(hard), items).collect()
    assert len(rows) == len(hard)
    by = {r.doc_id: (r.n_words, r.n_hit) for r in rows}
    assert by[1] == by[2] == by[3] == (0, 0) and by[4] == by[7] == (30_000, 3 * 31) and by[None] == (4, 0)
    assert sorted((r.n_words, r.n_hit) for r in rows if r.doc_id == 5) == [(1, 1), (1, 1), (5, 0)]
    assert contamination(docs([]), items).collect() == []
    assert {r.n_hit for r in contamination(docs(hard), benchmark(spark, [])).collect()} == {0}


def test_cleaned_texts(spark, docs):
    items = benchmark(spark, [(1, "the secret question is what comes next after all this"), (2, "Ünder way")])
    rows = [(1, "Before, THE secret question -- is what comes next after all this? After."), (2, "clean  text\n stays"), (3, "ünder Ünder WAY now"), (4, None), (5, "")]
    found = cleaned(docs(rows), items)
    assert found.columns == docs(rows).columns
    assert {r.doc_id: r.text for r in found.collect()} == {1: "Before, ? After.", 2: "clean  text\n stays", 3: "ünder  now", 4: None, 5: ""}


@pytest.mark.parametrize("seed", range(4))
def test_index_against_scanning(seed):
    draw = np.random.default_rng(seed)
    symbols = draw.integers(0, 4, 400) if seed else np.array([0] + [1] * 300 + [0] + [1, 2] * 100)
    symbols[0] = symbols[-1] = 0
    order = suffix_order(symbols)
    ends = np.append(np.flatnonzero(symbols == 0), len(symbols))
    key = lambda i: (symbols[i : (e := ends[ends >= i][0])].tolist(), e)
    rank = lambda i: [(v, 0) for v in key(i)[0]] + [(0, key(i)[1])]
    assert order.tolist() == sorted(range(len(symbols)), key=rank)
    index = FMIndex(symbols, 2)
    for n in (1, 2, 3, 7):
        patterns = np.array([symbols[a : a + n] for a in range(0, 380, 3) if (symbols[a : a + n] > 0).all()] + [[3] * n])
        low, high = index.search(patterns, np.full(len(patterns), n))
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(symbols) - n + 1) if (symbols[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_wavelet_matrix():
    symbols = np.random.default_rng(0).integers(0, 13, 200)
    tree = WaveletMatrix(symbols, 4)
    assert tree.access(np.arange(200)).tolist() == symbols.tolist()
    assert all(tree.rank(np.full(201, s), np.arange(201)).tolist() == [int((symbols[:i] == s).sum()) for i in range(201)] for s in (0, 5, 12, 15))


def test_no_windows():
    assert [x.tolist() for x in Windows.of([]).occurrences(np.array([0, 0]))] == [[], []]
