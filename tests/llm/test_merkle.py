"""The Merkle manifest against a plain version, over several tiers of superblocks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from helixframe.llm import merkle

H = merkle.digest


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain(rows, seen):
    """{row number: (leaf, subroot, root, proof, folded)} of rows (id, tree, text)."""
    leaves = {i: H("".join(map(field, r))) for i, r in enumerate(rows)}

    def climb(nodes):
        """Top, and each bottom node's [(left, right)] by level."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for path, j in zip(paths, at):
                s = j - j % 8
                path.append(("".join(level[s:j]), "".join(level[j + 1 : s + 8])))
            level = [H("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
            at = [j // 8 for j in at]
        return level[0], paths

    trees = sorted({r[1] for r in rows}, key=lambda t: (t is not None, (t or "").encode()))
    members, tops, own = {}, [], {}
    for t in trees:
        members[t] = sorted((i for i, r in enumerate(rows) if r[1] == t), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i], i))
        top, paths = climb([leaves[i] for i in members[t]])
        tops.append(top)
        own |= dict(zip(members[t], paths))
    root, outer = climb(tops)
    out = {}
    for t, top, upper in zip(trees, tops, outer):
        for i in members[t]:
            node, path = seen.get(i, leaves[i]), own[i] + upper
            for left, right in path:
                node = H(left + node + right)
            out[i] = (leaves[i], top, root, "".join(a + b for a, b in path), node)
    return out


def run(spark, rows, height, seen_text=None):
    df = spark.createDataFrame(rows, "id long, lang string, text string").repartition(3)
    cols = [F.col(c) for c in ("id", "lang", "text")]
    seen = None if seen_text is None else F.when(F.col("id") % 3 == 0, merkle.leaf([cols[0], cols[1], F.lit(seen_text)]))
    return merkle.manifest(df, "lang", "id", merkle.leaf(cols), seen, height=height).collect()


@pytest.mark.parametrize("height", [1, 2, 4])
def test_equals_the_plain_version(spark, height):
    rows = [(i * 7 % 1000, ["a", "b", None, "é"][0 if i < 150 else i % 4], None if i % 11 == 0 else "Text %d" % i * (i % 5)) for i in range(180)]
    rows += [(5000, "lone", "x"), (None, "a", "no id"), (7, "a", "Text 1" * 9000)]
    changed = {i: H("".join(map(field, (r[0], r[1], "tampered")))) for i, r in enumerate(rows) if r[0] is not None and r[0] % 3 == 0}
    want = sorted((rows[i][0] if rows[i][0] is not None else -1, *v) for i, v in plain(rows, changed).items())
    got = run(spark, rows, height, "tampered")
    assert sorted((r.id if r.id is not None else -1, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got) == want
    for r in got:
        assert r.verified == (r.folded_root == r.root)
        assert merkle.verify(r.leaf, r.proof, r.pos, r.size, r.tree, r.trees) == r.root
        assert r.verified == (r.id is None or r.id % 3 != 0)


def test_many_trees(spark):
    rows = [(i, f"t{i % 70:02d}", "x") for i in range(200)]
    want = plain(rows, {})
    got = {r.id: r for r in run(spark, rows, 1)}
    assert all((got[i].leaf, got[i].subroot, got[i].root, got[i].proof) == want[i][:4] for i in want)


def test_repeated_rows_have_a_place_each(spark):
    rows = [(1, "a", "same")] * 40
    got = run(spark, rows, 1)
    assert sorted(r.pos for r in got) == list(range(40)) and all(r.verified for r in got)


def test_edges(spark):
    assert run(spark, [], 4) == []
    (lone,) = run(spark, [(1, None, None)], 4)
    assert lone.leaf == lone.subroot == lone.root == hashlib.sha256(b"1:1--").hexdigest() and lone.proof == ""


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "x", 3, 4)], "id long, lang string, text string, pos int, key int")
    (row,) = merkle.manifest(df, "lang", "id", merkle.leaf([F.col("text")])).collect()
    assert row.root == H("1:x")
