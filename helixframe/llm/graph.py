"""Connected components of an edge table by contraction in bounded groups, never gathered in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix

#: Edges that one group contracts.
GROUP_EDGES = 200_000
#: Doublings of the hooks' reach in a round that needs several groups.
JUMPS = 2


def forest(a: np.ndarray, b: np.ndarray, scattered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) of every node of these edges: the label is its component's smallest node, or if ``scattered`` the one with the smallest hash."""
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    a, b = a[new], b[new]
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    if scattered:
        by = np.argsort(mix(nodes.view(np.uint64)), kind="stable")
        nodes, ends = nodes[by], np.argsort(by)[ends]
    up = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    label = np.array(up, dtype=np.int64)
    while not np.array_equal(label, label[label]):
        label = label[label]
    return nodes, nodes[label]


def _contract(scattered: bool):
    def run(key: tuple, edges: pa.Table) -> pa.Table:
        node, label = forest(edges.column("a").to_numpy(), edges.column("b").to_numpy(), scattered)
        return pa.Table.from_arrays([pa.array(node), pa.array(label)], ["node", "label"])

    return run


def hooked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` without the nodes that are their component's smallest: edges that connect the same nodes."""
    node, label = forest(a, b)
    return node[node != label], label[node != label]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the label is the component's smallest node.

    Edges are dealt by hash into groups of about GROUP_EDGES. Each group joins what it can, under the
    node with the smallest hash; a node then hooks to one of the labels that the groups gave it, and hooks follow
    each other. As hashes are in no order along a chain, a chain of hooks has a few links only, and of
    a path about a third of the nodes are left after a round. The groups' forests are contracted to the hooks,
    until one group holds what is left. The hooks are composed backwards, and each component is named after its
    smallest node. Self-loops and null ends give no labels; an empty table gives no rows.
    """
    current = materialize(edges.where("a <> b").select("a", "b").distinct())
    hooks: list[DataFrame] = []
    while n := current.count():
        groups = -(-n // GROUP_EDGES)
        dealt = current.withColumn("_group", F.pmod(F.xxhash64("a", "b"), F.lit(groups)))
        local = materialize(dealt.groupBy("_group").applyInArrow(_contract(bool(hooks) or groups > 1), "node long, label long"))
        if groups == 1:
            hooks.append(local)
            break
        hook = local.groupBy("node").agg(F.min_by("label", F.xxhash64("label")).alias("label"))
        for _ in range(JUMPS):
            hook = materialize(hook)
            further = hook.toDF("label", "further")
            hook = hook.join(further, "label").select("node", F.col("further").alias("label"))  # every label is a node
        hook = materialize(hook)
        hooks.append(hook)
        left, right = hook.toDF("node", "a"), hook.toDF("label", "b")
        current = materialize(local.join(left, "node").join(right, "label").where("a <> b").select("a", "b").distinct())
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).where("false")
    labels, composed = hooks.pop(), bool(hooks)
    if not composed:
        return labels
    while hooks:
        later = labels.toDF("label", "further")
        labels = hooks.pop().join(later, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    labels = materialize(labels)
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return materialize(labels.join(least, "label").select("node", F.col("least").alias("label")))
