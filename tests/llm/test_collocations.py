import random
import re
from collections import Counter

import numpy as np
import pytest

from concord.llm import collocations as c
from concord.llm.collocations import Index, collocations, compacted, frequent_filter, in_filter, linked, pair_hashes, phrase_counts

SCHEMA = "doc_id long, text string, lang string, n string, rank string, a string"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least=10, share=50, first=2_000):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            f.update((lang, *w[i : i + s]) for s in (1, 2, 3) for i in range(len(w) - s + 1))
    found = {}
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(100 * n >= share * a and n >= least and (list(x[1:3]) == w or list(x[2:]) == w) for x, n in f.items() if len(x) == 4 and x[0] == lang):
            continue
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((score, a, " ".join(w), f[lang, *w[:k]], f[lang, *w[k:]]))
    out = []
    for lang, x in found.items():
        x.sort(key=lambda t: (-t[0], -t[1], t[2].encode()))
        out += [(lang, i + 1, p, a, lo, r, total[lang], s) for i, (s, a, p, lo, r) in enumerate(x[:first])]
    return sorted(out)


def corpus(seed=1, n=150):
    draw = random.Random(seed)
    words = "The of to a é x, B. C; cat dog\tfox ran far! away ünd\nso New York City 漢 z\x0bq \x1cw".split(" ")
    rows = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", "  ", " ", "\t", ". ", "\n"]) for _ in range(draw.randrange(60)))
        rows.append((i, text, draw.choice(["en", "de", None, "und"])))
    return rows + [(None, "new york city " * 30, "en"), (1, None, "en"), (2, "", "fr"), (3, " .\n", "fr"), (3, "one two", "fr"), (3, "one two", "fr")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", "r", "a") for r in rows], SCHEMA)


@pytest.mark.parametrize("shard_words", [40, 1_000_000])
def test_same_phrases_as_brute_force(spark, shard_words):
    rows = corpus()
    got = sorted(map(tuple, collocations(frame(spark, rows), 3, shard_words=shard_words).collect()))
    want = brute(rows, 3)
    assert got == want and len(want) > 100 and {len(r[2].split(" ")) for r in want} == {2, 3}


def test_thresholds_and_first_rows(spark):
    rows = corpus(5)
    assert sorted(map(tuple, collocations(frame(spark, rows), 3, 80, 7).collect())) == brute(rows, 3, 80, 7)


def test_filters_that_let_everything_through_change_nothing(spark, monkeypatch):
    rows = corpus(9)
    monkeypatch.setattr(c, "WORD_BITS", 3)
    monkeypatch.setattr(c, "PAIR_BITS", 3)
    assert sorted(map(tuple, collocations(frame(spark, rows)).collect())) == brute(rows)


def test_counts_of_all_phrases(spark):
    rows = corpus(2)
    got = {(r.lang, r.phrase): r.n for r in phrase_counts(frame(spark, rows)).where("size > 0").collect()}
    f = Counter((lang or "und", " ".join(w[i : i + s])) for _, text, lang in rows for w in pieces(text) for s in (1, 2, 3) for i in range(len(w) - s + 1))
    assert got == {k: n for k, n in f.items() if n >= 10}


def test_hard_rows(docs, hard):
    found = sorted(map(tuple, collocations(docs(hard)).collect()))
    assert found == brute([(i, t, "en") for i, t in hard]) and len(found) > 900
    assert collocations(docs([])).collect() == [] and collocations(docs([(1, None), (2, "a b")])).collect() == []


def test_scores_of_large_counts_are_exact(spark, monkeypatch):
    a, lo, r = 3 * 10**12 + 7, 7 * 10**12 + 1, 9 * 10**12 + 5
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, lo), ("en", "y", 1, r), ("en", "", 0, 10**15)], "lang string, phrase string, size int, n long")
    monkeypatch.setattr(c, "phrase_counts", lambda *x: counts)
    assert [tuple(x) for x in collocations(counts).collect()] == [("en", 1, "x y", a, lo, r, 10**15, 10**6 * a * a // (lo * r))]


def test_extensions_are_exact_in_both_directions():
    draw = random.Random(4)
    for _ in range(20):
        seq = np.array([0] + [draw.randrange(6) for _ in range(60)] + [0])
        both = Index(seq, 3), Index(seq[::-1], 3)
        pairs, triples = Counter(zip(seq[:-1].tolist(), seq[1:].tolist())), Counter(zip(seq[:-2].tolist(), seq[1:-1].tolist(), seq[2:].tolist()))
        low, high = both[0].smaller[1:6], both[0].smaller[2:7]
        parent, symbol, new_low, new_high, offset = both[0].extended(low, high)
        got = {(int(x), int(p) + 1): int(n) for p, x, n in zip(parent, symbol, new_high - new_low)}
        assert got == {k: n for k, n in pairs.items() if k[1] > 0}
        back_low = low[parent] + offset
        up, third, to_low, to_high, _ = both[1].extended(back_low, back_low + new_high - new_low)
        got = {(int(symbol[u]), int(parent[u]) + 1, int(t)): int(n) for u, t, n in zip(up, third, to_high - to_low)}
        assert got == {k: n for k, n in triples.items() if k[1] > 0}


def test_words_left_out_end_runs():
    symbols, old = compacted(np.array([1, 2, 3, 3, 1, 0, 0, 2, 0]), np.array([False, True, True, False]))
    assert symbols.tolist() == [0, 1, 2, 0, 1, 0, 2, 0, 0] and old.tolist() == [0, 1, 2]


def test_runs_of_frequent_pairs_stay():
    hashes, held = np.arange(6, dtype=np.uint64) * np.uint64(77), np.zeros(1 << 13, np.uint8)
    for a, b in ((1, 2), (2, 3), (4, 5)):
        place = int(pair_hashes(hashes[[a]], hashes[[b]])[0]) % (1 << 16)
        held[place >> 3] |= 1 << (place & 7)
    seq = lambda *x: linked(np.array(x), hashes, held).tolist()
    assert seq(0, 1, 2, 3, 4, 5, 0, 1, 0, 2, 0) == [0, 1, 2, 3, 0, 4, 5, 0]
    assert seq(0, 1, 2, 0, 1, 2, 0) == [0, 1, 2, 0, 1, 2, 0] and seq(0, 3, 3, 0) == [0] and seq(0) == [0]


def test_a_filter_holds_what_is_frequent(spark):
    rows = spark.createDataFrame([(2**62 + 5, 6), (2**62 + 5, 4), (-7, 10), (3, 9)], "h long, n long")
    held = frequent_filter(rows, 10, 16)
    assert in_filter(held, np.array([2**62 + 5, -7, 3, 8]).view(np.uint64)).tolist() == [True, True, False, False]
