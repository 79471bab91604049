"""Components against a plain search: one portion, many portions, long paths, nothing."""

import random

import pytest

from weftgraph.plans.components import star_components
from weftgraph.plans.scratch import Scratch


def plain(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    of = {}
    for start in sorted(near):
        todo = [start] if start not in of else []
        while todo:
            x = todo.pop()
            if x not in of:
                of[x] = start
                todo += near[x]
    return of


rng = random.Random(5)
GRAPHS = {
    "random": [(rng.randrange(-40, 200), rng.randrange(-40, 200)) for _ in range(150)],
    "path": [(i, i + 1) for i in rng.sample(range(120), 120)],
    "hub": [(500, i) for i in range(150)] + [(i, 500) for i in range(30)],
    "loops and nulls": [(1, 1), (None, 2), (3, None), (7, 5), (5, 7), (7, 5)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("at_once", [1 << 19, 16])
def test_components(spark, name, at_once):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    found = star_components(df, Scratch(spark, "components"), at_once=at_once).collect()
    assert len(found) == len({r["id"] for r in found})
    assert {r["id"]: r["component"] for r in found} == plain(edges)
