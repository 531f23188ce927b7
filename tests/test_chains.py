"""Fixpoints of graphs with few nodes of several edges out, against the solvers and plain walks."""

import random

import numpy as np
import pytest

from codeloom.operators import chains, graph as graphs, solvers
from codeloom.operators.graph import CodeGraph
from codeloom.sinks import diagrams

MIXES = [(1, 0), (2, 2)]


def mixed(seed, hubs, n=30):
    """One edge out of most nodes, loops among them, and more out of some."""
    r = random.Random(seed)
    edges = [(k, r.randrange(n)) for k in range(n) if r.random() < 0.9]
    return edges + [(r.randrange(n), r.randrange(n)) for _ in range(hubs * 3)]


def both(spark, edges, nodes=40):
    e, n = spark.createDataFrame(edges, "src long, dst long"), spark.range(nodes)
    return CodeGraph.of(e, n), CodeGraph.of(e, n, -1).kept()


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture
def cuts(monkeypatch):
    made = []
    for module in (chains, graphs):
        plain = module.cut
        monkeypatch.setattr(module, "cut", lambda df, plain=plain: made.append(1) or plain(df))
    return made


@pytest.mark.parametrize("seed,hubs", MIXES)
def test_components_of_mixed_graphs(spark, seed, hubs):
    a, b = both(spark, mixed(seed, hubs))
    assert rows(a.components()) == rows(b.components())
    assert rows(a.condensed().edges) == rows(b.condensed().edges) and rows(a.condensed().nodes) == rows(b.condensed().nodes)
    assert rows(a.cycle_edges()) == rows(b.cycle_edges())


@pytest.mark.parametrize("seed,hubs", MIXES)
def test_layers_of_mixed_graphs(spark, seed, hubs):
    a, b = both(spark, mixed(seed, hubs))
    assert rows(a.layers()) == rows(b.layers()) and rows(a.layers(condense=False)) == rows(b.layers(condense=False))


@pytest.mark.parametrize("seed,hubs", MIXES)
def test_reach_of_mixed_graphs(spark, seed, hubs):
    a, b = both(spark, mixed(seed, hubs))
    for start in (11,):
        assert rows(a.reach(start)) == rows(b.reach(start)) and rows(a.reach(start, False)) == rows(b.reach(start, False))
    assert rows(b.reach(99)) == rows(b.reach(99, False)) == []


@pytest.mark.parametrize("seed,hubs", MIXES)
def test_pagerank_of_mixed_graphs(spark, seed, hubs):
    a, b = both(spark, mixed(seed, hubs))
    assert rows(a.pagerank(tolerance=0.0, iterations=6)) == rows(b.pagerank(tolerance=0.0, iterations=6))
    assert rows(a.pagerank(tolerance=1e-2)) == rows(b.pagerank(tolerance=1e-2))


def counted(edges, n):
    """Pairs of other nodes whose one path crosses each node."""
    to, found = {a: b for a, b in edges if a != b}, [0] * n
    for s in range(n):
        walk, v = [], s
        while v in to and to[v] != s and to[v] not in walk:
            v = to[v]
            walk.append(v)
        for k, v in enumerate(walk):
            found[v] += len(walk) - 1 - k
    return found


@pytest.mark.parametrize("seed", range(2))
def test_betweenness_where_nodes_have_one_edge(spark, seed):
    edges = mixed(seed, 0)
    a, b = both(spark, edges)
    want = [(k, round(x / (39 * 38), 9)) for k, x in enumerate(counted(edges, 40))]
    assert rows(a.betweenness()) == want and rows(b.betweenness()) == want


def test_crossings_equal_the_walks_of_the_solver():
    import numpy as np

    for seed in range(20):
        e = np.array(sorted({(a, b) for a, b in mixed(seed, 0, 50) if a != b}))
        assert np.allclose(solvers.crossings(50, e[:, 0], e[:, 1]) / (49 * 48), solvers.betweenness(50, e[:, 0], e[:, 1], range(50)))


def test_one_edge_betweenness_walks_no_source(spark, monkeypatch):
    monkeypatch.setattr(solvers, "betweenness", lambda *a, **k: pytest.fail("walked"))
    a, _ = both(spark, [(k, k + 1) for k in range(5)], 6)
    assert rows(a.betweenness()) == [(k, round(k * (5 - k) / 20, 9)) for k in range(6)]


def test_deep_graphs_take_few_rounds(spark, cuts):
    deep = [(k, k + 1) for k in range(300)] + [(300, 200)]
    _, g = both(spark, deep, 302)
    assert dict(rows(g.layers()))[0] == 200 and len(g.reach(0).collect()) == 300 and len(g.cycles().collect()) == 101
    assert len(cuts) < 150


def test_pagerank_takes_rounds_as_walks_are_long(spark, cuts):
    tree = [(k, k // 3) for k in range(1, 39)]
    _, g = both(spark, tree, 40)
    want = solvers.pagerank(40, *(np.array(x) for x in zip(*tree)), tolerance=0.0)
    assert rows(g.pagerank(tolerance=0.0)) == [(k, round(x, 9)) for k, x in enumerate(want)]
    assert len(cuts) < 20


@pytest.mark.parametrize("seed,hubs", [(1, 0), (2, 2)])
def test_pagerank_ends_on_the_driver(spark, cuts, monkeypatch, seed, hubs):
    e = mixed(seed, hubs)
    a, b = both(spark, e)
    b.small_edges = 30
    walks = []
    plain = graphs._walks
    monkeypatch.setattr(graphs, "_walks", lambda *x: walks.append(1) or plain(*x))
    assert rows(a.pagerank(tolerance=0.0)) == rows(b.pagerank(tolerance=0.0)) and walks


@pytest.mark.parametrize("seed,hubs", MIXES)
def test_cycles_keep_no_rows_of_other_nodes(spark, monkeypatch, seed, hubs):
    a, b = both(spark, mixed(seed, hubs))
    plain = CodeGraph._components_loop
    monkeypatch.setattr(CodeGraph, "_components_loop", lambda g, whole=True: pytest.fail("whole") if whole else plain(g, whole))
    assert rows(b.cycle_breaks()) == rows(a.cycle_breaks())


def test_all_edges_are_shown_without_a_join(spark):
    _, g = both(spark, [(0, 1), (1, 0), (2, 0)], 3)
    marked = diagrams._marked_edges(g, g.nodes, None)
    assert "Join" not in marked._jdf.queryExecution().toString()
    assert rows(diagrams.mermaid_edges(g, g.nodes, g.cycles())) == [("    _0 -.->|cycle| _1",), ("    _1 -.->|cycle| _0",), ("    _2 --> _0",)]
