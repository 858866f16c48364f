import random

import pytest

from concord.operators import graphs


def parts(edges):
    """Node to the largest node of its strongly connected part, for nodes on a cycle, by plain reachability."""
    nodes = {n for e in edges for n in e}
    onward = {n: {b for a, b in edges if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(onward[n])
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += onward[m]
        reach[n] = seen
    return {n: max(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}


def found(spark, edges):
    return {r.node: r.component for r in graphs.cycles(spark.createDataFrame(edges, "src int, dst int")).collect()}


def counted(monkeypatch):
    """Counts the tables that are written out."""
    calls, write = [], graphs.durable
    monkeypatch.setattr(graphs, "durable", lambda df: calls.append(1) or write(df))
    return calls


@pytest.mark.parametrize("seed, n, m", [(1, 30, 36), (3, 40, 55), (4, 12, 40)])
def test_cycles_against_reachability(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    # Loops on loops: a ring whose nodes carry rings of their own, one of them twice, and a tail on both sides.
    edges += [(100, 101), (101, 102), (102, 100), (101, 111), (111, 112), (112, 101), (112, 120), (120, 112), (90, 100), (102, 130), (130, 131)]
    assert found(spark, edges) == parts(edges)


def test_odd_edges(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, 2), (1, 2), (None, 1), (2, None), (5, 5)]) == {5: 5}


def test_long_ring_takes_doubling_steps(spark, monkeypatch):
    calls = counted(monkeypatch)
    n = 5000
    ring, tail = [(i, (i + 1) % n) for i in range(n)], [(n + i, n + i + 1) for i in range(999)] + [(7, n)]
    assert found(spark, ring + tail) == dict.fromkeys(range(n), n - 1)
    assert len(calls) < 60


def plain(nodes, edges):
    out = {n: [b for a, b in edges if a == n and b in nodes] for n in nodes}
    wave = {}
    while len(wave) < len(nodes):
        for n in nodes:
            if n not in wave and all(b in wave for b in out[n]):
                wave[n] = 1 + max((wave[b] for b in out[n]), default=0)
    return wave


def layered(spark, nodes, edges):
    return {r.node: r.wave for r in graphs.layers(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(edges, "src int, dst int")).collect()}


@pytest.mark.parametrize("seed, n, m", [(1, 60, 60), (2, 25, 70)])
def test_layers_against_peeling(spark, seed, n, m):
    rng = random.Random(seed)
    pairs = [sorted((rng.randrange(n), rng.randrange(n)), reverse=True) for _ in range(m)]
    edges = [tuple(p) for p in pairs if p[0] != p[1]] + [(3, 999), (998, 3)]
    assert layered(spark, range(n), edges) == plain(set(range(n)), edges)


def test_long_chain_and_cycles_of_layers(spark, monkeypatch):
    calls = counted(monkeypatch)
    n = 5000
    chain = [(i + 1, i) for i in range(n - 1)]
    assert layered(spark, range(n), chain) == {i: i + 1 for i in range(n)}
    assert len(calls) < 30
    assert layered(spark, [], []) == {}
    for loop in ([(0, n - 1)], [(5, 5)]):
        with pytest.raises(ValueError, match="cycle"):
            layered(spark, range(n), chain + loop)
