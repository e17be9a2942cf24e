import random

import pytest

from weavegrid.llm.common import connected_components


def brute(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("name", ["path", "random", "star", "two", "loop", "none"])
def test_components(name, spark):
    rng = random.Random(4)
    pairs = {
        "path": [(i, i + 1) for i in range(60)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "star": [(0, i) for i in range(1, 50)] + [(i, 0) for i in range(1, 50)],
        "two": [(5, 3), (9, 7), (7, 11)],
        "loop": [(1, 1)],
        "none": [],
    }[name]
    frame = spark.createDataFrame(pairs, "a long, b long")
    assert sorted(tuple(r) for r in connected_components(frame).collect()) == brute(pairs)
