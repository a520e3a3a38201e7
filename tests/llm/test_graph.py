import random

import numpy as np
import pytest

from helixframe.llm import graph
from helixframe.llm.common import mix


@pytest.mark.parametrize("limit", [60, 1000])
def test_components_of_stars_chains_and_loops(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "GROUP_EDGES", limit)
    r = random.Random(limit)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, 500 + i) for i in range(1, 50)] + [(900, 900)]
    edges += [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    node, label = graph.forest(np.array([a for a, _ in real]), np.array([b for _, b in real]))
    assert got == dict(zip(node.tolist(), label.tolist()))
    assert got[60] == 0 and got[549] == 500 and 900 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_chains_over_many_groups_end_in_few_rounds(spark, monkeypatch):
    rounds, real = [], graph.materialize
    monkeypatch.setattr(graph, "GROUP_EDGES", 60)
    monkeypatch.setattr(graph, "materialize", lambda df: rounds.append(1) or real(df))
    names = list(range(5000, 5201))
    random.Random(5).shuffle(names)
    edges = [(i, i + 1) for i in range(200)] + list(zip(names, names[1:]))  # seven groups
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).groupBy("label").count().collect()
    assert sorted((x.label, x["count"]) for x in got) == [(0, 201), (5000, 201)]
    assert len(rounds) <= 3 + 5 * 5  # five tables a round


def test_rounds_of_contraction_do_not_grow_with_a_chain():
    """What one round leaves of a path of 10,000 edges in 500 groups, without Spark: the same steps on arrays."""
    rounds, a, b = 0, np.arange(10_000), np.arange(1, 10_001)
    while len(a) > 20:
        group = np.random.default_rng(rounds).integers(0, -(-len(a) // 20), len(a))
        found = [graph.forest(a[group == g], b[group == g], True) for g in range(group.max() + 1)]
        node, label = (np.concatenate(x) for x in zip(*found))
        key = mix(label.view(np.uint64) + np.uint64(7))
        order = np.lexsort((key, node))
        nodes, first = np.unique(node[order], return_index=True)
        hook = label[order][first]
        for _ in range(graph.JUMPS):
            hook = hook[np.searchsorted(nodes, hook)]
        x, y = hook[np.searchsorted(nodes, node)], hook[np.searchsorted(nodes, label)]
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)))[:, x != y], axis=1)
        a, b = pairs
        rounds += 1
    assert rounds < 12
