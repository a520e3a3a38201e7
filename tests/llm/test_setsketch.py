"""SetSketch registers, their estimates, and near-duplicate classes against brute force."""

import numpy as np
import pytest

from helixframe.llm import setsketch as ss


def pair(rng, size, both):
    """Two sets of hashes of one size with ``both`` in common."""
    values = np.unique(rng.integers(0, 1 << 63, 3 * size, dtype=np.uint64))[: 2 * size - both]
    rng.shuffle(values)
    return np.sort(values[:size]), np.sort(values[size - both :])


def sketched(sets):
    sizes = [len(s) for s in sets]
    return ss.registers(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), len(sets))


@pytest.mark.parametrize("size,both", [(13, 12), (25, 23), (200, 184), (3000, 2757)])
def test_bands_find_pairs_at_the_threshold(size, both):
    rng = np.random.default_rng(size)
    pairs = [pair(rng, size, both) for _ in range(1500 if size < 1000 else 200)]
    keys = ss.band_keys(sketched([s for p in pairs for s in p])).reshape(len(pairs), 2, ss.BANDS)
    equal = (keys[:, 0] == keys[:, 1]).sum(axis=1)
    share = both / (2 * size - both)
    assert equal.min() >= 1 and abs(equal.mean() / (ss.BANDS * share**ss.ROWS) - 1) < 0.08


@pytest.mark.parametrize("size,both", [(40, 10), (40, 37), (500, 250), (500, 460)])
def test_joint_estimate(size, both):
    rng = np.random.default_rng(both)
    truth, found = both / (2 * size - both), []
    for _ in range(60):
        a, b = sketched(pair(rng, size, both)).astype(int)
        found.append(ss.joint_estimate(np.array([size]), np.array([size]), np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([(a == b).sum()]))[0])
    assert abs(np.mean(found) - truth) < 0.015
    assert np.sqrt(np.mean((np.array(found) - truth) ** 2)) < 1.5 * np.sqrt(truth * (1 - truth) / ss.REGISTERS) + 0.004


def test_sizes_sharpen_the_estimate():
    rng = np.random.default_rng(3)
    big = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    a, b = sketched([big[:300], big]).astype(int)
    found = ss.joint_estimate(np.array([300]), np.array([len(big)]), np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([(a == b).sum()]))[0]
    assert abs(found - 300 / len(big)) < 0.07


def test_sketches_merge():
    rng = np.random.default_rng(1)
    a, b = pair(rng, 300, 100)
    one, two, union = sketched([a, b, np.union1d(a, b)])
    assert (ss.merged(one, two) == union).all()


def test_minima_end_early_but_exactly():
    """The series that ends early gives the minima of all values of all n-grams."""
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    together = ss.minima(np.zeros(len(grams), dtype=np.int64), grams, 1)[0]
    alone = ss.minima(np.arange(len(grams)), grams, len(grams))  # a single n-gram needs its whole series
    assert np.isfinite(alone).all() and np.allclose(together, alone.min(axis=0))
    assert abs(alone.mean() * ss.RATE - 1) < 0.03  # exponential of that rate


def texts(rng):
    words = [f"w{i}" for i in range(4000)]
    base = [[words[i] for i in rng.integers(0, 4000, n)] for n in (30, 80, 200, 400, 5, 3)]
    rows = [" ".join(b) for b in base] + [" ".join(b) for b in base[:2]]
    for b in base[1:4]:
        for k in range(12):
            c = list(b)
            for i in rng.choice(len(c), max(1, len(c) // 120), replace=False):
                c[i] = words[rng.integers(0, 4000)]
            rows.append(" ".join(c))
    chain = list(base[2])
    for k in range(10):  # each near to the next, the last far from the first
        chain[17 * k] = f"changed{k}"
        rows.append(" ".join(chain).upper())
    return [*rows, None, "", " \t\n", "one two", "One TWO", "a b c d e"]


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted(((i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets)), key=str)


@pytest.mark.parametrize("chunk", [2048, 8])
def test_classes_equal_brute_force(spark, monkeypatch, chunk):
    from helixframe.llm import jaccard

    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 2)
    found = texts(np.random.default_rng(11))
    rows = list(enumerate(found)) + [(None, found[1]), (500, found[2]), (500, found[0])]  # a null id; one id with two texts
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ss.classes(df, n=5, num=85, den=100).collect()), key=str)
    assert got == brute(rows, 5, 85, 100)


def test_links_of_one_chunk_with_asking():
    rng = np.random.default_rng(4)
    a, b = pair(rng, 100, 96)
    c, d = pair(rng, 100, 97)
    nodes = np.arange(4)
    assert ss.sketch_links(nodes, [a, b, c, d], 85, 100) and len(ss.sketch_links(nodes, [a, b, c, d], 85, 100)) == 2
    assert ss.sketch_links(nodes, [a, b, c, d], 85, 100, np.array([False, False, False, True])) == [(3, 2)]


def test_empty_table(spark):
    assert ss.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
