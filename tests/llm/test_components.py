import random

import pytest

from tunelens.llm.components import components


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("rest", [0, 30, 10**6])
def test_chains_stars_and_random_links(spark, rest):
    rng = random.Random(rest)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 240)] + [(1, 1)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    frame = spark.createDataFrame(links * 2, "a long, b long").repartition(4)
    found = {r.id: r.component for r in components(frame, rest_links=rest).collect()}
    assert found == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
