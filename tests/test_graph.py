import random
from bisect import bisect_left
from collections import Counter

import pytest

from codeloom.catalog import QUERIES
from codeloom.operators import architecture, coupling, focus
from codeloom.operators.graph import CodeGraph, percentile, rounded, score_stats, top_scores
from codeloom.sinks import diagrams

SMALL, LOOP = 1_000_000, -1


def graph(spark, edges, nodes=(), small=SMALL):
    e = spark.createDataFrame(edges, "src string, dst string")
    return CodeGraph.of(e, spark.createDataFrame([(n,) for n in nodes], "id string"), small)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stats_of_empty_and_tiny_graphs(spark):
    g = graph(spark, [])
    assert rows(g.stats()) == [(0, 0, 0.0, 0, 0, 0.0, 0.0, 0, 0)] and rows(g.pagerank()) == [] and rows(g.layers()) == []
    one = graph(spark, [], ["a"])
    assert rows(one.pagerank()) == [("a", 1.0)] and rows(one.betweenness()) == [("a", 0.0)] and rows(one.isolated()) == [("a",)]


@pytest.mark.parametrize("small", [SMALL, LOOP])
def test_layers_and_cycles(spark, small):
    chain = graph(spark, [("a", "b"), ("b", "c")], small=small)
    assert rows(chain.layers()) == [("a", 2), ("b", 1), ("c", 0)]
    ring = graph(spark, [("a", "c"), ("c", "b"), ("b", "a")], ["s"], small)
    assert rows(ring.layers()) == [(x, 0) for x in "abcs"] and rows(ring.layers(condense=False)) == [("s", 0)]
    assert rows(ring.cycles()) == [("a", x) for x in "abc"] and rows(ring.cycle_breaks()) == [("a", "a", "c")]


def test_self_loops(spark):
    loop = [("a", "a"), ("b", "a")]
    assert rows(graph(spark, loop, ["c"]).layers()) == [("c", 0)]
    both = graph(spark, [*loop, ("d", "e"), ("e", "d")], ["c"])
    assert rows(both.layers()) == [("a", 0), ("b", 1), ("c", 0), ("d", 0), ("e", 0)]
    assert rows(both.cycles()) == [("d", "d"), ("d", "e")]


def test_betweenness_of_a_bridge(spark):
    g = graph(spark, [("a", "x"), ("b", "x"), ("x", "c"), ("x", "d")])
    bc = g.betweenness()
    assert dict(rows(bc))["x"] == pytest.approx(4 / 12)
    found = focus.bridges(g, bc, g.pagerank()).collect()
    assert [r.id for r in found] == ["x"] and found[0].risk == "high" and found[0].description.startswith("connects 2 importers to 2 dependencies")


def random_graph(seed, n=14, m=26):
    r = random.Random(seed)
    return [(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)], [f"n{k:02}" for k in range(n)]


def test_loops_give_what_the_solvers_give(spark):
    e, n = random_graph(3)
    a, b = graph(spark, e, n), graph(spark, e, n, LOOP).kept()
    near = lambda x, y: all(p[0] == q[0] and p[1] == pytest.approx(q[1], abs=1e-9) for p, q in zip(rows(x), rows(y), strict=True))
    assert near(a.pagerank(tolerance=0, iterations=8), b.pagerank(tolerance=0, iterations=8))
    assert rows(a.components()) == rows(b.components())
    assert rows(a.layers()) == rows(b.layers())
    assert near(a.betweenness(), b.betweenness())
    assert rows(a.reach("n03")) == rows(b.reach("n03")) and rows(a.reach("n03", False)) == rows(b.reach("n03", False))


def test_scores(spark):
    s = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.5), ("d", 0.2)], "id string, score double")
    assert rows(percentile(s)) == [("a", 0.0), ("b", 50.0), ("c", 50.0), ("d", 25.0)]
    assert [r.id for r in top_scores(s, 2).collect()] == ["b", "c"]
    assert rows(score_stats(s)) == [(0.5, 0.1, 0.325, 0.5)]


def test_percentiles_of_equal_scores_summed_in_other_orders(spark):
    half = 1.725e-07
    s = spark.createDataFrame([("a", half * (1 - 3e-16)), ("b", half), ("c", half * (1 + 3e-16)), ("d", 1e-7)], "id string, score double").filter("score > 0")
    assert rows(percentile(s.withColumn("score", rounded("score", 9)))) == [("a", 25.0), ("b", 25.0), ("c", 25.0), ("d", 0.0)]


@pytest.mark.parametrize("small", [True, False])
def test_percentiles_equal_those_of_exact_scores(spark, monkeypatch, small):
    """All keys are orders with one customer each, so a score is a sum of counts of walks, here in integers."""
    monkeypatch.setattr(CodeGraph, "is_small", lambda g: small)
    sf = "/root/testdata/sf0.1"
    to = dict(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").toPandas().itertuples(index=False))
    assert set(to.values()) <= set(to)
    walks, score = dict.fromkeys(to, 1), Counter()
    for j in range(21):
        weight = 3 * 17**j * 20 ** (20 - j) if j < 20 else 20 * 17**20
        score.update({k: weight * m for k, m in walks.items()})
        ends = Counter()
        for k, m in walks.items():
            ends[to[k]] += m
        walks = ends
    whole = len(to) * 20**21
    assert sum(score.values()) == whole
    halves = {k: divmod(2 * 10**9 * x, whole) for k, x in score.items()}
    assert sum(h % 2 == 1 and not rest for h, rest in halves.values()) > 1000
    places = sorted((h + 1) // 2 for h, _ in halves.values())
    want = {k: round(100 * bisect_left(places, (h + 1) // 2) / len(to), 6) for k, (h, _) in halves.items()}
    assert dict(QUERIES["score_percentile"](spark, sf).toPandas()[["id", "percentile"]].itertuples(index=False)) == want


def test_small_neighbourhoods_shuffle_no_edges(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("d", "a")], small=LOOP)
    joined = []
    from codeloom.operators import graph as graphs

    plain = graphs.spread_small
    try:
        graphs.spread_small = lambda ids: joined.append(plain(ids)) or joined[-1]
        assert rows(g.distances("a", 2)) == [("a", 0), ("b", 1), ("c", 2)]
    finally:
        graphs.spread_small = plain
    plan = g.edges.join(joined[0].withColumnRenamed("id", "src"), "src")._jdf.queryExecution().simpleString()
    assert len(joined) == 2 and "BroadcastHashJoin" in plan
    scores = g.nodes.selectExpr("id", "0.1D as score")
    assert {r.id for r in focus.focus(g, scores, "a").collect()} == {"a", "b", "c", "d"}


def test_focus(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("d", "a"), ("c", "e"), ("e", "f"), ("f", "tests/test_a.py"), ("a", "g"), ("g", "a")])
    s = g.nodes.selectExpr("id", "0.1D as score")
    got = {r.id: (r.distance, r.direction) for r in focus.focus(g, s, "a").collect()}
    assert got == {"a": (0, "focal"), "b": (1, "dependency"), "c": (2, "dependency"), "e": (3, "dependency"), "d": (1, "dependent"), "g": (1, "both")}
    assert focus.focus(g, s, "zz").count() == 0
    line = focus.focus_summary(g, focus.focus(g, s, "a"), "a").first()
    assert (line.neighborhood, line.max_depth, line.direct_dependencies, line.direct_dependents) == (6, 3, 2, 2)
    assert rows(focus.dependencies_of(g, "a").select("relation", "id")) == [("dependency", "b"), ("dependency", "g"), ("dependent", "d"), ("dependent", "g")]


def test_coupling(spark):
    g = graph(spark, [("p/a", "q/b"), ("p/c", "q/b")], ["r/z"])
    d = spark.createDataFrame([("q/b", "interface"), ("q/b", "class"), ("p/a", "class")], "path string, type string")
    m = {r.id: r for r in coupling.coupling(g, coupling.definition_counts(d)).collect()}
    assert (m["q/b"].ca, m["q/b"].ce, m["q/b"].i, m["q/b"].a) == (2, 0, 0.0, 0.5)
    assert (m["r/z"].i, m["r/z"].d, m["r/z"].zone) == (0.5, 0.5, "neutral") and m["p/a"].zone == "main"
    dirs = {r.directory: (r.ca, r.ce) for r in coupling.directory_coupling(g).collect()}
    assert dirs == {"p": (0, 1), "q": (2, 0), "r": (0, 0)}


def test_second_pass_takes_files_in_order(spark):
    g = graph(spark, [("m1", "src/model/x"), ("m2", "m1"), ("m0", "m9"), ("m3", "m0")], ["alone", "src/database/y"])
    got = {r.id: (r.layer, r.method) for r in architecture.classify(g).collect()}
    assert got["src/model/x"] == ("domain", "path") and got["src/database/y"] == ("infrastructure", "path")
    assert got["m1"] == ("infrastructure", "imports") and got["m2"] == ("shared", "imports")
    # m9 is settled after m0, so m0 knows no dependency
    assert got["alone"][0] == "shared" and got["m0"] == ("domain", "imports") and got["m3"] == ("infrastructure", "imports")


def test_exports(spark):
    g = graph(spark, [("a.py", "b.py"), ("b.py", "a.py"), ("9c.py", "a.py")])
    s = spark.createDataFrame([("a.py", 0.5), ("b.py", 0.01)], "id string, score double")
    text = diagrams.export(g, "mermaid", s, g.cycles())
    assert text.splitlines()[:3] == ["graph LR", '    _9c_py["9c.py"]', '    a_py[("a.py")]'] and "    a_py -.->|cycle| b_py" in text and "    _9c_py --> a_py" in text and "    class a_py highCentrality" in text
    dot = diagrams.export(g, "dot", s, g.cycles())
    assert '"a.py" [label="a.py", width=3.00, style=filled, fillcolor="#ff9999"];' in dot and '"a.py" -> "b.py" [color=red' in dot
    assert '"edge_count": 3' in diagrams.export(g, "json", s, g.cycles(), g.layers())
    with pytest.raises(ValueError):
        diagrams.export(g, "png")
    assert "subgraph root" in diagrams.diagram(g) and "==>|cycle|" in diagrams.diagram(g, "cycles") and "subgraph layer_0" in diagrams.diagram(graph(spark, [("a", "b")]), "layers")
