import hashlib
import random

import numpy as np

from concord.llm import substring
from concord.llm.substring import block_cells, deduplicated, found_cells, packed, unpacked


def brute(rows, k=13):
    first = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()}


def corpus():
    draw = random.Random(5)
    text = lambda n: [draw.choice("abcdefghij") + str(draw.randrange(40)) for _ in range(n)]
    one, two, three = text(60), text(13), text(12)
    rows = [text(30) + one, one[10:40] + text(20), text(9) + one[5:30] + two + text(4), two, three + text(3), text(5) + three, ["x"] * 50, ["x"] * 20 + text(5), one + two]
    rows += [text(3) + one[20:45] + one[20:45] for _ in range(4)]
    rows += [text(draw.randrange(40)) for _ in range(10)]
    return [(i, "  ".join(r)) for i, r in enumerate(rows)]


def test_same_words_as_brute_force(docs):
    rows = corpus()
    assert got(deduplicated(docs(rows))) == brute(rows)


def test_many_small_blocks_buckets_and_joins(docs, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(substring, "BLOCK_EDGES", 20)
    assert got(deduplicated(docs(rows).repartition(3), bucket_edges=50, broadcast_ids=0)) == brute(rows)


def test_hard_rows(docs, hard):
    found = deduplicated(docs(hard)).collect()
    assert len(found) == len(hard)
    by = {r.doc_id: r for r in found}
    assert by[4].n_removed == 0 and by[7].n_removed == 30_000 and by[7].kept == "" and by[1].n_words == 0 and by[None].n_removed == 0
    assert [(s.begin, s.end) for s in by[7].spans] == [(0, 30_000)]
    assert deduplicated(docs([])).collect() == []


def test_an_edge_travels_once_from_a_block():
    h = np.array([5, 5, 5, 9], np.uint64) << np.uint64(40)
    doc, at = np.array([3, 1, 2, 1]), np.array([0, 4, 1, 5])
    out = list(block_cells(h, doc, at, 1, 1))
    met = [unpacked(b, 3) for _, kind, b in out if kind == 0]
    found = [unpacked(b, 4) for _, kind, b in out if kind == 1]
    assert [x.tolist() for x in met[0][1:]] == [[1, 1], [4, 5]]
    assert [x.tolist() for x in found[0]] == [[2, 3], [1, 0], [1, 1], [4, 4]]
    assert not list(found_cells(doc, at, doc, at, np.zeros(4, bool), 1))


def test_packing_is_a_round_trip():
    a = np.array([0, -1, 2**62, 7])
    assert [x.tolist() for x in unpacked(packed(a, a[::-1]), 2)] == [a.tolist(), a[::-1].tolist()]


def test_false_matches_remove_nothing():
    from concord.llm.common import WordHash

    words, gone = substring.removed_words(b"a b c d", [{"begin": 0, "length": 2, "digest": b"no"}], WordHash(), 3)
    assert len(words) == 4 and not gone.any()
