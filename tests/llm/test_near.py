import itertools
import random

import pytest

from concord.llm.components import components
from concord.llm.near import near_duplicates, verified


def brute(rows):
    """Component of each id by comparing all pairs of word-run sets."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def corpus(seed=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    passage = text(60)
    rows = []
    base = text(220)
    for _ in range(40):  # a group of near copies
        copy = list(base)
        for _ in range(draw.randint(0, 9)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append(copy)
    for n in (20, 30, 70, 90):  # a common passage with little and with much besides
        rows += [passage + text(n) for _ in range(8)]
    chain = text(100)
    for _ in range(10):  # each like the one before, the ends unlike
        chain = chain[4:] + text(4)
        rows.append(list(chain))
    rows += [text(draw.randint(1, 12)) for _ in range(20)]
    rows += [list(rows[0]), list(rows[0]), [w.upper() for w in rows[0]], rows[41] + ["end"]]
    draw.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_same_components_as_all_pairs(docs):
    rows = corpus()
    assert got(near_duplicates(docs(rows))) == brute(rows)


def test_the_threshold_itself_links(docs):
    # 4 shared of 5; 3 shared of 4, exactly 75 percent; 3 shared of 5
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (10, "k l m n o p q"), (11, "k l m n o p q r"), (20, "s t u v w x y z"), (21, "s t u v w x y q")]
    found = got(near_duplicates(docs(rows)))
    assert [found[i][1] for i, _ in rows] == [1, 1, 10, 10, 20, 21] and found == brute(rows)
    apart = [(1, "a b c d e f g"), (2, "a b c d e f g h i")]
    assert [got(near_duplicates(docs(apart)))[i][1] for i in (1, 2)] == [1, 2]


def test_hard_rows(docs, hard):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(hard)).collect()]
    assert len(rows) == len(hard)
    by = {r[0]: r for r in rows}
    assert by[None][2:] == (None, True) and by[1] == (1, 0, 1, True) and by[2][1:] == (0, 2, True) and by[3][1:] == (0, 3, True)
    assert by[7][2:] == (4, False) and by[4][2:] == (4, True)
    assert got(near_duplicates(docs([]))) == {}


def test_ids_beyond_the_broadcast_bound(docs, monkeypatch):
    from concord.llm import near

    monkeypatch.setattr(near, "BROADCAST_IDS", 0)
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "x y z")]
    pairs = docs(rows).sparkSession.createDataFrame([(2, 1), (3, 1)], "a long, b long")
    assert [tuple(r) for r in verified(docs(rows), pairs, 5, 75, "doc_id", "text").collect()] == [(2, 1)]


@pytest.mark.parametrize("edges", [[(2, 1), (3, 2), (5, 4)], [(9, i) for i in range(1, 9)], [(i + 1, i) for i in range(1, 30)], [(7, 7)], []])
def test_components(spark, edges):
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_components_go_on_from_known_ones(spark):
    make = lambda edges: spark.createDataFrame(edges, "a long, b long")
    got = lambda found: sorted((r.node, r.root) for r in found.collect())
    early, late = [(2, 1), (3, 2), (5, 4), (9, 8)], [(5, 3), (7, 6), (8, 7), (12, 11), (3, 1), (6, 6)]
    assert got(components(make(late), components(make(early)))) == got(components(make(early + late)))
    assert got(components(make([]), components(make(early)))) == got(components(make(early)))
    assert got(components(make([(3, 1)]), components(make(early)))) == got(components(make(early)))
    assert got(components(make(late), components(make([])))) == got(components(make(late)))


def test_small_components_take_few_tasks(spark):
    """The driver keeps something of every task; a loop over some ids must not take hundreds a step."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    links = spark.createDataFrame([(i + 1, i) for i in range(1, 30)], "a long, b long")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("small components", "")
        assert {r.root for r in components(links).collect()} == {1}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("small components")]
    stages = {s for j in jobs for s in j.stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert 0 < tasks < 1_200, tasks
