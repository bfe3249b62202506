"""Connected components against union-find, and how many rounds they take."""

import random

import pytest


class Counting:
    """A scratch folder that notes what is written."""

    def __init__(self, spark):
        from kestrel.llm.blocks import Scratch
        self.inner, self.names = Scratch(spark, "components"), []

    def keep(self, df, name):
        self.names.append(name)
        return self.inner.keep(df, name)


def _edges(kind):
    rng = random.Random(7)
    chain = list(range(300))
    rng.shuffle(chain)
    if kind == "chain":
        return list(zip(chain, chain[1:]))
    if kind == "hub":
        return [(150, x) for x in range(400) if x != 150]
    if kind == "loops and repeats":
        return [(1, 1), (2, 3), (3, 2), (2, 3), (-5, 3), (9, 9), (7, 8)]
    return [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]


@pytest.mark.parametrize("kind", ["chain", "hub", "loops and repeats", "random", "none"])
@pytest.mark.parametrize("task_nodes", [4, 1 << 20])
def test_components(spark, monkeypatch, kind, task_nodes):
    from kestrel.llm import components as C
    monkeypatch.setattr(C, "TASK_NODES", task_nodes)
    edges = [] if kind == "none" else _edges(kind)
    forest = C.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {(x, forest.root(x)) for a, b in edges if a != b for x in (a, b)}
    got = C.components(spark.createDataFrame(edges, "a long, b long").repartition(3), Counting(spark)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_edges_of_one_task_need_no_round(spark):
    from kestrel.llm.components import components
    scratch = Counting(spark)
    components(spark.createDataFrame(_edges("chain"), "a long, b long").coalesce(1), scratch)
    assert scratch.names == ["edges"]


def test_stars_need_no_further_round(spark):
    from kestrel.llm.components import components
    scratch = Counting(spark)
    components(spark.createDataFrame([(k, 10 + k) for k in range(8)], "a long, b long").repartition(4), scratch)
    assert scratch.names == ["edges"]
