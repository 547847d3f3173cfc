import random

import pytest

from marginscope.llm.components import connected_components


def slow(edges):
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops"])
def test_equal_to_propagation(spark, kind):
    rnd = random.Random(5)
    edges = {
        "path": [(k, k + 1) for k in rnd.sample(range(60), 55)],
        "star": [(99, k) for k in range(40)] + [(200, 100 + k) for k in range(5)],
        "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)],
        "loops": [(3, 3), (1, 2), (2, 1), (1, 2)],
    }[kind]
    edges = [(a, b) for a, b in edges]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == slow([(a, b) for a, b in edges if a != b])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_edges_connect_the_same():
    import numpy as np

    from marginscope.llm.components import spanning_edges

    rnd = random.Random(2)
    for n in (0, 1, 5, 40):
        edges = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(n)]
        a, b = spanning_edges(np.array([x for x, _ in edges], dtype=np.int64), np.array([y for _, y in edges], dtype=np.int64))
        few = list(zip(a.tolist(), b.tolist()))
        whole = slow(edges)
        assert {k: v for k, v in slow(few).items()} == {k: v for k, v in whole.items() if k in slow(few)}
        assert len(few) == len(whole) - len(set(whole.values()))
