import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from concord.llm import components
from concord.llm.spellings import PositionIndex, cells, near_pairs, noted_words, slab_pairs, spellings, vocabulary

SCHEMA = "doc_id long, text string, word string, n string, root string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", "n", "r") for i, t in rows], SCHEMA)


def plain_words(rows, shortest=6, least=5, typo=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, times=5, **more):
    words = plain_words(rows, **more)
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], form[w] and words[form[w]], root))
    return out


def got(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def corpus(seed=1):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdeéÿ") for _ in range(draw.randrange(6, 11))) for _ in range(25)]

    def edited(w):
        i, c = draw.randrange(len(w)), draw.choice("abé")
        return draw.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c])

    words = []
    for w in stems:
        words += [w] * draw.choice([5, 30, 160])
        for _ in range(8):
            v = edited(w)
            words += [v] * draw.choice([3, 5, 6, 26]) + [edited(v)] * 5
    draw.shuffle(words)
    text = [draw.choice([w, w.upper(), w.title()]) if w.isascii() else w for w in words]
    return [(i, draw.choice([" ", "-", "1"]).join(text[i * 20 : i * 20 + 20])) for i in range(len(text) // 20 + 1)]


@pytest.mark.parametrize(("cell", "typo"), [(2_048, 199), (3, 7)])
def test_same_words_as_brute_force(spark, cell, typo):
    rows = corpus(2_048)
    want = brute(rows, typo=typo)
    assert got(spellings(frame(spark, rows), typo=typo, cell=cell)) == want
    assert len(want) > 100 and (typo < 199 or any(r[3] and r[5] != r[3] for r in want)) and max(r[2] for r in want) > 3


def test_forms_are_followed_to_the_last(spark, monkeypatch):
    """A chain of forms, in one partition of the loop and in many."""
    chain = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(i, f"{w} " * 5 ** (i + 1)) for i, w in enumerate(chain)] + [(9, "apart! " * 5 + "aparts " * 5)]
    want = brute(rows, typo=10**10)
    assert {(w, root) for w, *_, root in want} == {(w, chain[-1]) for w in chain} | {("aparts", "aparts")}
    assert got(spellings(frame(spark, rows), typo=10**10)) == want
    monkeypatch.setattr(components, "PART_ROWS", 1)
    assert got(spellings(frame(spark, rows), typo=10**10)) == want


def test_hard_rows(docs, hard):
    more = [(None, "Straßen straßen STRASSE " * 5), (8, "wo×den ÷÷÷÷÷÷ " * 6), (9, "a" * 20_000 + " " + "a" * 19_999), (9, "漢字漢字漢字漢字 \U0001f600abcdef " * 5)]
    rows = hard + more
    assert got(spellings(docs(rows))) == brute(rows)
    assert spellings(docs([])).collect() == [] and spellings(docs([(1, None), (2, "short")])).collect() == []


def test_typos_follow_the_hash():
    for doc_id in range(300):
        text = "Walking éèéèéè walking abcdef"
        assert sum(noted_words(str(doc_id), text, 1, 3).values()) == 4
        words = {w.decode("latin-1"): n for w, n in noted_words(str(doc_id), text, 6, 3).items()}
        assert words == plain_words([(doc_id, text)], least=1, typo=3)


def test_position_index_finds_all_near_words():
    draw = random.Random(3)
    for n in (1, 5, 64, 65, 300):
        words = list({"".join(draw.choice("abc") for _ in range(draw.randrange(3, 7))) for _ in range(n)})
        index = PositionIndex(words)
        for size in (3, 4, 5, 6, 9):
            queries = ["".join(draw.choice("abcx") for _ in range(size)) for _ in range(20)]
            query, word = index.near(queries)
            want = {(i, j) for i, q in enumerate(queries) for j, w in enumerate(words) if is_near(q, w) and len(w) >= len(q)}
            assert set(zip(query.tolist(), word.tolist())) == want


def test_groups_of_a_slab_stay_apart():
    words, group, side = ["abcdef", "abcdeg", "abcdeh", "abcdef"], np.array([0, 0, 0, 1]), np.array([0, 0, 1, 0])
    whole, split = np.zeros(4, bool), np.ones(4, bool)
    pairs = lambda s: sorted(zip(*(x.tolist() for x in slab_pairs(6, words, group, side, s))))
    assert pairs(whole) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert pairs(split) == [(0, 2), (1, 2), (2, 0), (2, 1)]


def test_a_hot_group_is_split_and_loses_no_pair(spark):
    draw = random.Random(8)
    words = list({"prefix" + "".join(draw.choice("ab") for _ in range(6)) for _ in range(200)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    met = cells(df, 10)
    assert met.groupBy("size", "part", "key", "row", "col").count().agg({"count": "max"}).first()[0] <= 60
    got = [(r.word, r.near) for r in near_pairs(df, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if is_near(a, b)}


def test_vocabulary_counts_whole_texts(spark):
    rows = [(1, "lengthy " * 40_000), (1, "lengthy"), (2, "LENGTHY x lengthy")]
    assert {r.word: r.n for r in vocabulary(frame(spark, rows), least=1).collect()} == plain_words(rows, least=1)
