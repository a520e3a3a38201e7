"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf; the leaves of each tree (one for each value of a column) ascend by an order column, and
every FAN consecutive nodes become one. A superblock is FAN ** HEIGHT consecutive nodes of one tree.

1. Leaf digests are made by the JVM where the rows are read; only digests and keys travel further.
2. Leaves are sorted by range. What each sorted part holds of each tree (a few rows a part) gives every leaf its
   position, and each tree its number.
3. Upwards, each superblock is reduced to its top; tops are the nodes of the next tier, until a tree has one
   node, its subroot. Subroots, in the order of the trees, are the nodes of one more tree, whose top is the root.
4. Downwards, each tier's nodes and what lies outside of their superblock (the siblings on its way to the root) are
   cogrouped by superblock. The lowest cogroup reduces its leaves, joins their proofs and folds them.

No group holds over FAN ** HEIGHT nodes and a few outer rows, whatever a tree's share of the rows. Leaves can be given as
they were found later (``seen``); the fold of such a leaf with the untampered siblings shows what was changed.

Defined cases: a null field is "-"; a null tree value is the first tree; a null order value comes first. Equal order
values are ordered by digest; wholly equal rows have a place each. Empty and very long texts are fields like others. A lone
leaf is its tree's subroot, a lone subroot the root; a run of one node is hashed like any other while its tree has
more nodes. An empty table gives no rows. Columns that are not named are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Nodes of a run, and levels of a superblock.
FAN, HEIGHT = 8, 4
#: So many (sorted part, tree) rows are sent to all tasks at most (about 60 bytes each).
FEW = 100_000
NODE = "tree long, pos long, size long, digest string"
PATH = "tree long, block long, lefts array<string>, rights array<string>, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: its fields, each with its length in bytes, nulls as "-"."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f), F.lit(":"), f), F.lit("-")) for f in shown]), 256)


# ---------------------------------------------------------------- one superblock


def levels(nodes: list[str], size: int, height: int) -> list[list[str]]:
    """The superblock's nodes, and every level above: up to one node if it is its whole tree of ``size``, else ``height`` levels."""
    out = [nodes]
    while len(out[-1]) > 1 if size <= FAN**height else len(out) <= height:
        below = out[-1]
        out.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def siblings(level: list[str], i: int) -> tuple[str, str]:
    """What stands left and right of node i in its run."""
    start = i - i % FAN
    return "".join(level[start:i]), "".join(level[i + 1 : start + FAN])


def fold(node: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The digest that a node leads to through the siblings of each level."""
    for left, right in zip(lefts, rights):
        node = digest(left + node + right)
    return node


def proofs(below: list[list[str]], above: str) -> list[str]:
    """The siblings of each bottom node level by level, then what lies above the superblock."""
    text = [above]
    for level in reversed(below[:-1]):
        text = ["".join(siblings(level, i)) + text[i // FAN] for i in range(len(level))]
    return text


def local_path(below: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """Left and right siblings of bottom node i in each level of its superblock."""
    found = []
    for level in below[:-1]:
        found.append(siblings(level, i))
        i //= FAN
    return [x[0] for x in found], [x[1] for x in found]


def verify(leaf_digest: str, proof: str, position: int, size: int, tree: int, trees: int) -> str:
    """The root that one leaf's digest and its proof lead to: ``position`` of ``size`` leaves, tree number ``tree`` of ``trees``."""
    node, at = leaf_digest, 0
    for place, n in ((position, size), (tree, trees)):
        while n > 1:
            start = place - place % FAN
            left, right = place - start, min(start + FAN, n) - place - 1
            cut = at + 64 * left
            node = digest(proof[at:cut] + node + proof[cut : cut + 64 * right])
            at, place, n = cut + 64 * right, place // FAN, -(-n // FAN)
    return node


# ---------------------------------------------------------------- Spark


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (id, key, leaf, seen, row) with ``tree``, ``pos`` in it and its ``size``."""
    ordered = materialize(rows.repartitionByRange("key", "id", "leaf", "row").sortWithinPartitions("key", "id", "leaf", "row"))
    number = F.monotonically_increasing_id()  # of the stored parts: part and place in it
    ordered = ordered.withColumn("at", number).withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    runs = ordered.groupBy("part", "key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by_key = Window.partitionBy("key")
    earlier = F.sum("n").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = materialize(runs.withColumn("before", F.coalesce(earlier, F.lit(0).cast("long"))).withColumn("size", F.sum("n").over(by_key)))
    heads = runs.where("before = 0").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("first")))
    # one row for each part in which trees begin
    begun = heads.groupBy("part").count().withColumn("earlier", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    trees = heads.join(begun, "part").select(F.col("key").alias("named"), (F.col("earlier") + F.col("rank") - 1).alias("tree"))
    numbered = runs.join(trees, F.col("key").eqNullSafe(F.col("named"))).drop("named")
    numbered = materialize(numbered.withColumnsRenamed({"part": "of", "key": "named"}))
    if numbered.limit(FEW + 1).count() <= FEW:
        numbered = F.broadcast(numbered)
    placed = ordered.join(numbered, (F.col("part") == F.col("of")) & F.col("key").eqNullSafe(F.col("named")))
    return placed.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).select("id", "key", "leaf", "seen", "tree", "pos", "size")


def _block(height: int) -> Column:
    return F.expr(f"pos DIV {FAN**height}").alias("block")


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    """The node that each superblock is reduced to, as a node of the next tier."""

    def top(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        tree, size, first = (int(group[c].iloc[0]) for c in ("tree", "size", "pos"))
        return pd.DataFrame({"tree": [tree], "pos": [first // span], "size": [-(-size // span)], "digest": [levels(group["digest"].tolist(), size, height)[-1][0]]})

    span = FAN**height
    return nodes.select("tree", "pos", "size", "digest").groupBy("tree", _block(height)).applyInPandas(top, NODE)


def _tiers(nodes: DataFrame, most: int, height: int) -> list[DataFrame]:
    """The tiers from the nodes up, the last of one node for each tree; ``most`` is the largest tree's size."""
    found = [nodes]
    while True:
        found.append(materialize(_tops(found[-1], height)))
        if most <= FAN**height:
            return found
        most = -(-most // FAN**height)


def _below(nodes: DataFrame, outer: DataFrame, height: int, subroots: bool = False) -> DataFrame:
    """The way to the root of every node: its superblock's way (``outer``) behind its own siblings."""

    def join(inner: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos").reset_index(drop=True)
        below, up = levels(inner["digest"].tolist(), int(inner["size"].iloc[0]), height), way.iloc[0]
        paths = [local_path(below, i) for i in range(len(inner))]
        names = inner["digest"] if subroots else [up["subroot"]] * len(inner)
        own = {"lefts": [p[0] + list(up["lefts"]) for p in paths], "rights": [p[1] + list(up["rights"]) for p in paths], "subroot": names, "root": [up["root"]] * len(inner)}
        places = {"tree": inner["pos"], "block": 0} if subroots else {"tree": inner["tree"], "block": inner["pos"]}
        return pd.DataFrame(places | own)

    inner = nodes.select("tree", "pos", "size", "digest", _block(height))
    return inner.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(join, PATH)


def _finish(leaves: pd.DataFrame, way: pd.DataFrame, height: int) -> pd.DataFrame:
    """A superblock's leaves with their proofs and what they, as they were seen, fold to."""
    leaves = leaves.sort_values("pos").reset_index(drop=True)
    below, up = levels(leaves["digest"].tolist(), int(leaves["size"].iloc[0]), height), way.iloc[0]
    lefts, rights = list(up["lefts"]), list(up["rights"])
    intact = fold(below[-1][0], lefts, rights)  # what untampered leaves fold to
    folded = []
    for i, (own, seen) in enumerate(zip(below[0], leaves["seen"])):
        if not isinstance(seen, str) or seen == own:
            folded.append(intact)
        else:
            left, right = local_path(below, i)
            folded.append(fold(seen, left + lefts, right + rights))
    out = leaves[["id", "digest", "tree", "pos", "size"]].rename(columns={"digest": "leaf"})
    out["subroot"], out["root"] = up["subroot"], up["root"]
    out["proof"] = proofs(below, "".join(a + b for a, b in zip(lefts, rights)))
    out["folded_root"] = folded
    out["verified"] = out["folded_root"] == up["root"]
    return out


def manifest(rows: DataFrame, tree: str, order: str, leaf: Column, seen: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """A row for each row: the order column, leaf, tree, pos, size, trees, subroot, root, proof (the siblings' digests
    from the leaf to the root), folded_root and verified.

    ``leaf`` is each row's digest, ``seen`` the digest as found later (null: unchanged).
    """
    kind = rows.schema[order].dataType
    fields = [F.col(order).alias("id"), F.col(tree).alias("key"), F.unhex(leaf).alias("leaf"), F.unhex(seen if seen is not None else F.lit(None).cast("string")).alias("seen")]
    leaves = materialize(rows.select(*fields).withColumn("row", F.monotonically_increasing_id()))
    placed = _numbered(leaves)
    placed = placed.select(F.col("id").cast("string").alias("id"), F.lower(F.hex("leaf")).alias("digest"), F.lower(F.hex("seen")).alias("seen"), "tree", "pos", "size")
    most, trees = placed.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("tree") + 1, F.lit(0))).first()
    tiers = _tiers(placed, most, height)
    uppermost = _tiers(tiers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("size"), "digest"), trees, height)
    none = F.array().cast("array<string>")
    way = uppermost[-1].select("tree", F.lit(0).cast("long").alias("block"), none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(uppermost[:-1]):
        way = materialize(_below(nodes, way, height, subroots=nodes is uppermost[0]))
    for nodes in reversed(tiers[1:-1]):
        way = materialize(_below(nodes, way, height))
    names = ["leaf string", "tree long", "pos long", "size long", "subroot string", "root string", "proof string", "folded_root string", "verified boolean"]
    finish = lambda leaves, outer: _finish(leaves, outer, height)
    done = placed.select("*", _block(height)).groupBy("tree", "block").cogroup(way.groupBy("tree", "block")).applyInPandas(finish, ", ".join(["id string", *names]))
    return done.select(F.col("id").cast(kind).alias(order), *[n.split()[0] for n in names], F.lit(trees).cast("long").alias("trees"))
