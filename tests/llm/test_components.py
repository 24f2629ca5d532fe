"""Components by contraction in tasks against a search of the graph."""

import random

import numpy as np
import pytest

from sonority.llm import components


def reached(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    return root


def graphs():
    chance = random.Random(7)
    yield [(chance.randrange(-400, 400), chance.randrange(-400, 400)) for _ in range(350)]
    chain = list(range(0, 900, 3))
    chance.shuffle(chain)
    yield list(zip(chain, chain[1:])) + [(10**15, k) for k in range(1, 200, 3)]
    yield [(5, 5), (None, 3), (3, None), (None, None), (8, 9), (8, 9), (9, 8)]
    yield []


@pytest.mark.parametrize("pairs", list(graphs()))
@pytest.mark.parametrize("held", [1 << 20, 16])
def test_contracted_components(spark, monkeypatch, pairs, held):
    monkeypatch.setattr(components, "CONTRACTED", held)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    found = components.contracted_components(edges)
    assert found.columns == ["node", "root"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == reached(pairs)


def test_contraction_leaves_stars(spark):
    pairs = [(k, k + 1) for k in range(5000)]
    assert sorted(map(tuple, components.contracted(spark.createDataFrame(pairs, "a long, b long").coalesce(1)).collect())) == [(k, 0) for k in range(1, 5001)]


def test_stars_of_random_orders():
    chance = np.random.default_rng(3)
    for size in (1, 2, 50, 3000):
        u, v = chance.integers(0, size, size), chance.integers(0, size, size)
        told = dict(zip(*(x.tolist() for x in components.stars(u, v))))
        assert told == {n: r for n, r in reached(zip(u.tolist(), v.tolist())).items() if n != r}
