import random

from skyledger.llm.components import components


def expected(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent if sum(find(v) == find(u) for u in parent) > 1}


def test_components_of_chains_stars_and_random_edges(llm):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(draw.randrange(300, 380), draw.randrange(300, 380)) for _ in range(50)] + [(5, 5), (-3, 9)]
    found = components(llm.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.vertex: r.component for r in found} == expected(edges) and len(found) == len(expected(edges))


def test_no_edges(llm):
    assert components(llm.createDataFrame([], "a long, b long"), "a", "b").count() == 0
