"""What operators take as tables grow: where searches begin, jobs of connected components."""

import random

import numpy as np
import pytest

from quire.llm import ann, graph


def test_searches_that_begin_later_find_no_less():
    rng = np.random.default_rng(31)
    vectors, ids = rng.normal(size=(3000, 16)), rng.permutation(9000)[:3000]
    shard = ann.Shard(ids, vectors, float(np.log2(np.linalg.norm(vectors, axis=1).max())))
    # Half of the vectors tried need a radius as large, so only windows of that size and more are counted.
    assert shard.begin > 3
    asked = slice(0, 40)
    late = list(shard._search(vectors[asked], ids[asked], 20))
    begin, shard.begin = shard.begin, 0
    early = list(shard._search(vectors[asked], ids[asked], 20))
    for (a, sa, _, la), (b, sb, _, lb) in zip(late, early):
        assert la == max(lb, begin) and (sa >= sb).all()
        if lb >= begin:
            assert a.tolist() == b.tolist()
    assert sum(lb >= begin for *_, lb in early) >= 10


@pytest.mark.parametrize("few", [graph.FEW, 0])
def test_components_equal_a_walk_and_few_edges_take_few_jobs(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(32)
    edges = [(i + 1, i) for i in range(300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(90)] + [(-5, 2000), (7, 7)]
    up = {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up.setdefault(a, a)
            up[b] = a
            up.setdefault(b, a)
    jobs = lambda: spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()
    table = spark.createDataFrame(edges, "a long, b long")
    before = jobs()
    found = graph.components(table)
    used = jobs() - before
    assert sorted((r.node, r.root) for r in found.collect()) == sorted((x, root(x)) for x in up)
    assert graph.components(table.limit(0)).collect() == []
    assert not few or used <= 8
