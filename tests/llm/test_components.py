"""Connected components: against union by hand, and how many tables the rounds write."""

import random

import pytest

from symloom.llm import components


def by_hand(edges):
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {x: top(x) for x in parent}


def run(spark, edges, monkeypatch):
    """Roots by node, and the names of the tables written."""
    names, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: names.append(name) or write(df, name))
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["root"] for r in rows}, names


@pytest.mark.parametrize("rounds, edges", [(0, [(0, i) for i in range(1, 300)]), (0, [(5, 3), (3, 5), (9, 7)]), (1, [(i, 300) for i in range(300)]), (1, [(1, 2), (2, 3)])])
def test_rounds_end_with_stars(spark, monkeypatch, rounds, edges):
    """Stars below their smallest node need no round; what one round makes stars of needs no second one."""
    found, names = run(spark, edges, monkeypatch)
    assert found == by_hand(edges)
    assert names.count("small-star") == rounds


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_hand(spark, monkeypatch, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(10**6), 400)
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(170)] + list(zip(ids[:90], ids[1:91], strict=True))
    edges = [(a, b) for a, b in edges if a != b]
    found, _ = run(spark, edges, monkeypatch)
    assert found == by_hand(edges)
