import random

import numpy as np
import pytest

from helixframe.llm import jaccard


def brute_classes(rows, n, num, den):
    sets = {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        sets[key] = grams
    label = {k: k for k in sets}
    keys = sorted(sets)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                both = len(sets[a] & sets[b])
                if both and den * both >= num * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {k: (len(sets[k]), label[k]) for k in keys}


def near_copies(seed, groups=12, copies=9, words=60):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(3, words))]
        for _ in range(r.randrange(1, copies)):
            text = list(base)
            for _ in range(r.randrange(0, 4)):
                text[r.randrange(len(text))] = f"x{r.randrange(50)}"
            if r.random() < 0.3:
                text += [f"y{r.randrange(9)}" for _ in range(r.randrange(4))]
            rows.append((len(rows), " ".join(text).title() if r.random() < 0.2 else " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("num", [50, 80, 85])
def test_trie_links_span_the_components_of_all_links(seed, num):
    r = random.Random(seed)
    sets = []
    for _ in range(8):
        base = r.sample(range(1000), r.randrange(2, 120))
        for _ in range(r.randrange(1, 9)):
            sets.append(np.array(sorted(set(base) - set(r.sample(base, min(len(base) - 1, r.randrange(0, 8)))) | set(r.sample(range(1000), r.randrange(0, 5)))), dtype=np.uint64))
    nodes = np.arange(len(sets))
    real = [set(s.tolist()) for s in sets]

    def parts(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        first = {}
        return [first.setdefault(x, i) for i, x in enumerate(label)]

    every = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(real[a] & real[b]) >= num * len(real[a] | real[b])]
    found = jaccard.trie_links(nodes, sets, num, 100)
    assert all((max(p), min(p)) in every for p in found)
    assert parts(found) == parts(every)
    asking = np.array([r.random() < 0.5 for _ in sets])
    cross = [(a, b) for a, b in every if asking[a] or asking[b]]
    assert parts(jaccard.trie_links(nodes, sets, num, 100, asking)) == parts(cross)


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_classes_match_brute_force(spark, n, num):
    rows = near_copies(1) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  two"), (1005, "two one")]
    rows += [(1006 + i, rows[0][1]) for i in range(5)] + [(2000, "long " * 30_000), (2001, "long " * 29_999)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, node string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, n=n, num=num).collect()}
    assert found == brute_classes(rows, n, num, 100)


def test_chunked_components_lose_no_link(spark, monkeypatch):
    rows = near_copies(3, groups=3, copies=40)
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, n=2, num=60).collect()}
    assert found == brute_classes(rows, 2, 60, 100)


def test_empty_table_null_ids_and_repeated_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.classes(none).collect() == []
    text, other = " ".join(map(str, range(40))), " ".join(map(str, range(100, 140)))
    docs = spark.createDataFrame([(None, text), (5, text), (5, other), (7, other), (8, text)], "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.component_id) for r in jaccard.classes(docs).collect())
    assert [x for x in found if x[0] > 0] == [(5, 5), (5, 5), (7, 5), (8, 5)]
    assert [r.doc_id for r in jaccard.keep_one(docs).collect()] == [5]


def test_keep_one_leaves_one_row_of_each_class_and_all_rows_without_words(spark):
    text, other = " ".join(map(str, range(40))), " ".join(map(str, range(100, 140)))
    rows = [(None, text), (None, text), (9, text), (9, text), (9, " "), (None, other), (None, other + " x"), (3, None), (3, None), (None, ""), (4, "one two")]
    docs = spark.createDataFrame([(k, t, "a", 1, 2, True) for k, t in rows], "doc_id long, text string, _gone string, id int, row int, worded boolean")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == 7 and sorted(x for x in found if x[0] is not None and x[1]) == [(4, "one two"), (9, " "), (9, text)]
    assert found.count((3, None)) == 2 and found.count((None, "")) == 1 and sum(x[0] is None and bool(x[1]) for x in found) == 1
    assert jaccard.keep_one(docs.where("false")).collect() == []


def shuffled(df):
    """Bytes that the exchanges of the plan of ``df`` wrote when it ran."""

    def walk(node):
        own = node.metrics().apply("dataSize").value() if node.getClass().getSimpleName() == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_only_rows_that_a_join_can_match_are_moved(spark):
    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(10**9)}" for _ in range(200))
    rows = [(i, text()) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(4)]
    docs, whole = spark.createDataFrame(rows, "doc_id long, text string"), sum(len(t) for _, t in rows)
    dealt = spark.createDataFrame([(i, jaccard.nodes_of(*jaccard.sets_of([rows[i][1].encode()], 5))[0].item(), 1, 0) for i in range(4)], "id long, node long, comp long, chunk long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept, sets = jaccard.keep_one(docs), jaccard._set_rows(docs, dealt, "doc_id", "text", 5)
        assert sorted(x.doc_id for x in kept.collect()) == list(range(300))
        assert sorted(x.node for x in sets.collect()) == sorted(x.node for x in dealt.collect())
        assert 0 < shuffled(kept) < whole / 10 and 0 < shuffled(sets) < whole / 10
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FILTER_PART", 64)
    monkeypatch.setattr(jaccard, "FILTER_MOST", 128)
    ids = spark.range(2000)
    assert ids.where(jaccard.perhaps_in(ids.where("id % 3 = 0"))("id")).where("id % 3 = 0").count() == 667
