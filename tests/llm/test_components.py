import random

import pytest

from codeloom.llm.components import components


def brute(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 30)] + [(100, k) for k in range(101, 120)], [(random.Random(5).randrange(80), random.Random(k).randrange(80)) for k in range(50)], [(5, 3), (3, 5), (5, 3), (9, -4)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)
