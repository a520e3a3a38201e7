"""Hand-made genotypes, parity rules and properties of the statistics operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import scalar as X
from helixframe.operators import admixture, ancestry, diversity, genotype, intervals, kinship, ld, packed, sfs, summarize

CALLS = "rep int, chrom string, pop string, site_id int, position double, ind int, hap int, allele int"


@pytest.fixture(scope="module")
def tiny(spark):
    """Four individuals at six sites: monomorphic, fixed, tri-allelic, a correlated pair, and one at the same place."""
    sites = {0: (100, [0] * 8), 1: (200, [1] * 8), 2: (300, [0, 1, 2, 0, 1, 0, 0, 2]), 3: (5300, [0, 0, 0, 1, 1, 1, 0, 1]), 4: (10301, [0, 0, 0, 1, 1, 1, 0, 1]), 5: (10301, [1, 0, 0, 0, 0, 0, 0, 0])}
    rows = [(1, "1", "A", s, float(p), h // 2, h % 2 + 1, a) for s, (p, alleles) in sites.items() for h, a in enumerate(alleles)]
    rows += [(1, "1", "B", s, float(p), h // 2, h % 2 + 1, 0) for s, (p, _) in sites.items() for h in range(4)]
    return spark.createDataFrame(rows, CALLS)


def test_spectrum_bins_count_each_derived_allele(tiny):
    got = {(r["pop"], r.derived_allele_count): r["count"] for r in sfs.sfs_1d(tiny).collect()}
    assert got == {("A", 8): 1, ("A", 2): 2, ("A", 4): 2, ("A", 1): 1, ("B", 0): 6}
    dense = sfs.sfs_dense(tiny)
    assert dense.count() == 9 + 5 and dense.agg(F.sum("count")).first()[0] == 12
    square = sfs.sfs_2d_dense(tiny, ["A", "B"])
    assert square.count() == 9 * 5 and square.agg(F.sum("count")).first()[0] == 6 and square.where("count > 0").count() == sfs.sfs_2d(tiny, ["A", "B"]).count()


def test_joint_spectrum_has_the_single_ones_as_margins(tiny):
    joint = sfs.sfs_2d(tiny, ["A", "B"])
    margin = {r.pop1_count: r.n for r in joint.groupBy("pop1_count").agg(F.sum("count").alias("n")).collect()}
    single = {r.derived_allele_count: r["count"] for r in sfs.sfs_1d(tiny).where("pop = 'A'").collect()}
    assert margin == single
    assert sfs.sfs_2d(tiny, ["B", "A"]).select("pop1").distinct().first()[0] == "B"


def test_diversity_of_known_sites(spark, tiny):
    spans = spark.createDataFrame([(1, "1", 1000.0)], "rep int, chrom string, span double")
    got = {(r["pop"], r.stat): r for r in diversity.pi_theta(tiny, spans).collect()}
    pi = (1 - (4 * 3 + 2 + 2) / 56) + 2 * (1 - 24 / 56) + (1 - 42 / 56)
    assert got["A", "pi"].value == pytest.approx(pi / 1000)
    a_n = sum(1 / i for i in range(1, 8))
    assert got["A", "theta"].segregating_sites == pytest.approx(5 / 1000) and got["A", "theta"].value == pytest.approx(5 / 1000 / a_n)
    assert got["A", "pi"].segregating_sites is None and got["B", "pi"].value == 0
    assert got["A", "pi"].ne_value == pytest.approx(pi / 1000 / (4 * 2.36e-8))


def test_genome_pi_correction_and_errors(spark):
    rows = spark.createDataFrame([(1, "1", "A", "pi", 0.2, 1e-8, 100.0, None, 2.0), (1, "2", "A", "pi", 0.4, 1e-8, 300.0, None, 9.0), (1, "1", "A", "theta", 0.1, 1e-8, 100.0, 0.3, 2.0), (1, "2", "A", "theta", 0.1, 1e-8, 300.0, None, 9.0)], "rep int, chrom string, pop string, stat string, value double, mutation_rate double, span double, segregating_sites double, wattersons_const double")
    h = spark.createDataFrame([("A", 10)], "pop string, haplotypes long")
    got = {r.stat: r for r in diversity.genome_pi_theta(rows, h).collect()}
    assert got["pi"].value == pytest.approx(0.35 * 10 / 9) and got["pi"].wattersons_const is None
    assert got["theta"].value == pytest.approx(0.3 * 100 / 400 / 2.0)  # the null adds no sites but its span counts
    assert diversity.genome_pi_theta(rows, h, corrected=False).where("stat = 'pi'").first().value == pytest.approx(0.35)
    with pytest.raises(Exception, match="unknown statistic"):
        diversity.genome_pi_theta(rows.withColumn("stat", F.lit("x")), h).collect()
    with pytest.raises(Exception, match="too few haplotypes"):
        diversity.genome_pi_theta(rows, h.where("false")).collect()


def test_ld_bins_are_right_closed_and_flat_sites_only_count(spark, tiny):
    spans = spark.createDataFrame([(1, "1", 3e6)], "rep int, chrom string, span double")
    got = {(r["pop"], r.distance_bin_bp): r for r in ld.decay(tiny, spans, maf=0.0).collect()}
    # Places 100, 200, 300, 5300 and twice 10301: what is within 5000, within 10000 (10001 is not) and beyond.
    assert {b: got["A", b].n_pairs for p, b in got if p == "A"} == {5000: 4, 10000: 4, 15000: 6}
    exact = ld.decay(tiny.where("site_id in (3, 4)"), spans, maf=0.0).where("pop = 'A'").collect()
    assert [(r.distance_bin_bp, r.n_pairs, round(r.mean_r2, 9), r.window_start, r.window_end) for r in exact] == [(10000, 1, 1.0, 0, 2000000)]
    flat = ld.decay(tiny.where("site_id in (0, 3)"), spans, maf=0.0).where("pop = 'A'").first()
    assert (flat.n_pairs, flat.n_valid, flat.sum_r2, flat.mean_r2) == (1, 0, 0.0, None)
    assert ld.decay(tiny.where("site_id in (4, 5)"), spans, maf=0.0).count() == 0  # distance 0
    edges = spark.createDataFrame([(1,), (5000,), (5001,)], "d long").select(X.right_closed_bin("d", 5000).alias("b")).collect()
    assert [r.b for r in edges] == [5000, 5000, 10000]


def test_maf_pools_populations_and_uses_allele_one(tiny):
    maf = {r.site_id: r.maf for r in genotype.pooled_maf(tiny).collect()}
    assert maf[2] == pytest.approx(2 / 12) and maf[1] == pytest.approx(4 / 12) and maf[0] == 0


def test_pruning_drops_the_copy(tiny):
    wide = ld.wide(tiny.where("pop = 'A' AND site_id in (0, 2, 3, 4)"))
    kept = {r.site_id for r in ld.prune(wide, r2=0.5).collect()}
    assert kept >= {0, 3} and 4 not in kept


def test_pruning_in_blocks_equals_one_pass(spark, monkeypatch):
    r = random.Random(4)
    base = [[r.randrange(3) for _ in range(30)] for _ in range(12)]
    sites = [[x if r.random() < 0.8 else r.randrange(3) for x in base[r.randrange(12)]] for _ in range(90)]
    rows = [(rep, "1", s, float(10 * s), g) for rep in (1, 2) for s, g in enumerate(sites)]
    df = spark.createDataFrame(rows, "rep int, chrom string, site_id int, position double, dosage array<int>")

    def plain(window, step, limit):
        n, p = len(sites), [sum(g) / 60 for g in sites]
        minor, alive = [min(x, 1 - x) for x in p], [True] * len(sites)

        def r2(a, b):
            m, k = 30, sum(x * y for x, y in zip(a, b))
            va, vb = m * sum(x * x for x in a) - sum(a) ** 2, m * sum(x * x for x in b) - sum(b) ** 2
            return (m * k - sum(a) * sum(b)) ** 2 / (va * vb)

        for at in range(0, n - 1, step):
            for i in range(at, min(at + window, n)):
                for j in range(i + 1, min(at + window, n)):
                    if alive[i] and alive[j] and r2(sites[i], sites[j]) > limit:
                        alive[i if minor[i] < minor[j] else j] = False
        return {(rep, s) for rep in (1, 2) for s in range(n) if alive[s]}

    for block in (20, 25, 512):
        monkeypatch.setattr(ld, "BLOCK", block)
        assert {(x.rep, x.site_id) for x in ld.prune(df, window=20, step=7, r2=0.3).collect()} == plain(20, 7, 0.3)


def test_large_families_drop_as_one_by_one(spark, monkeypatch):
    r = random.Random(12)
    rows = [(1, "A", f"s{a:03}", f"s{b:03}", 0.2) for a in range(30) for b in range(a) if r.random() < 0.12]
    rows += [(2, "A", "hub", f"t{i:02}", 0.3) for i in range(9)] + [(2, "A", f"t{i:02}", f"t{i + 1:02}", 0.3) for i in range(8)]
    pairs = spark.createDataFrame(rows, "rep int, pop string, sample1 string, sample2 string, kinship double")
    want = set()
    for rep in (1, 2):
        near = {}
        for k, _, a, b, _ in rows:
            if k == rep:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        everyone = set(near)
        while any(near.values()):
            worst = min(near, key=lambda x: (-len(near[x]), x))
            for other in near.pop(worst):
                near[other].discard(worst)
            everyone.discard(worst)
        want |= {(rep, x) for x in everyone}
    for most in (100_000, 12):
        monkeypatch.setattr(kinship, "FAMILY_PAIRS", most)
        monkeypatch.setattr(kinship, "ROUNDS", 6)
        assert {(x.rep, x["sample"]) for x in kinship.unrelated_set(pairs, ["rep", "pop"]).collect()} == want


def test_king_tiles_equal_one_matrix(spark, monkeypatch):
    r = random.Random(8)
    rows = [(1, "1", "A", s, float(s), 3 * i, h, r.randrange(2)) for s in range(9) for i in range(7) for h in (1, 2)]
    calls = spark.createDataFrame(rows, CALLS)
    whole = sorted(tuple(x) for x in kinship.king_partials(calls).collect())
    assert len(whole) == 21 and all(x[3] < x[4] for x in whole)
    monkeypatch.setattr(kinship, "IND_BLOCK", 6)
    monkeypatch.setattr(kinship, "SITE_BLOCK", 4)
    assert sorted(tuple(x) for x in kinship.king_partials(calls).collect()) == whole


def test_king_partials_add_over_chromosomes(spark):
    g = {"1": [[0, 1, 2, 1], [1, 1, 0, 2]], "2": [[1, 1, 1, 0], [1, 1, 1, 0]]}
    rows = [(1, c, "A", 10 * int(c) + s, 1.0 * s, i, h, int(g[c][i][s] > h - 1)) for c in g for i in (0, 1) for s in range(4) for h in (1, 2)]
    calls = spark.createDataFrame(rows, CALLS)
    parts = kinship.king_partials(calls)
    genome = kinship.kinship(parts, ["rep", "pop"]).first()
    het = [3 + 2, 3 + 2]
    squares = sum((a - b) ** 2 for c in g for a, b in zip(*g[c]))
    het = [sum(x == 1 for c in g for x in g[c][i]) for i in (0, 1)]
    assert genome.kinship == pytest.approx(0.5 - squares / (4 * min(het))) and (genome.sample1, genome.sample2) == ("A_1", "A_2")
    same = kinship.kinship(parts.where("chrom = '2'"), ["rep", "chrom", "pop"]).first()
    assert same.kinship == 0.5  # identical genotypes


def test_unrelated_set_drops_the_best_connected(spark):
    pairs = spark.createDataFrame([(1, "A", "a", "b", 0.2), (1, "A", "b", "c", 0.2), (1, "A", "c", "d", 0.01), (1, "A", "e", "f", 0.3)], "rep int, pop string, sample1 string, sample2 string, kinship double")
    kept = kinship.unrelated_set(pairs, ["rep", "pop"])
    assert {r["sample"] for r in kept.collect()} == {"a", "c", "d", "f"}
    chain = spark.createDataFrame([(1, "A", f"s{i:02}", f"s{i + 1:02}", 0.5) for i in range(40)], pairs.schema)
    assert {r.family for r in kinship.families(chain, ["rep", "pop"]).collect()} == {"s00"}
    assert {r["sample"] for r in kinship.unrelated_set(chain, ["rep", "pop"]).collect()} == {f"s{i:02}" for i in range(0, 41, 2)}
    assert [(r.sample1, r.sample2) for r in kinship.among(pairs, kept, ["rep", "pop"]).collect()] == [("c", "d")]
    assert kinship.both_ways(pairs).count() == 8


def test_ancestry_ids_labels_and_zero_spans(spark):
    rows = [("ADX", 7, 70, 0.0, 10.0, 0, 1), ("ADX", 7, 71, 0.0, 30.0, 1, 1), ("ADX", 8, 80, 0.0, 5.0, 2, 1), ("ADX", 7, 71, 30.0, 40.0, 2, 1)]
    seg = spark.createDataFrame(rows, "pop string, ind long, node long, left double, right double, population int, ancestor int")
    got = {r.sample_id: r for r in ancestry.global_ancestry(seg).collect()}
    assert got["ADX_8"].vcf_sample_id == "ADX_1" and got["ADX_8"].afr_prop == 0.25 and got["ADX_8"].span == 40.0
    assert got["ADX_9"].span == 0 and got["ADX_9"].afr_prop is None
    local = ancestry.local_ancestry(seg, "3").collect()
    assert {r.population_name for r in local} == {"AFR", "EUR", "ADX"} and {r.hap for r in local} == {1, 2} and local[0].chrom == "chr3"


def test_positional_zip_and_label_errors(spark):
    fam = spark.createDataFrame([(0, "0", "A_1_2"), (1, "0", "B_1")], "row_idx long, fid string, iid string")
    q = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.2, 0.8)], "row_idx long, afr_q double, eur_q double")
    assert [r["pop"] for r in ancestry.zip_q(fam, q).orderBy("row_idx").collect()] == ["A", "B"]
    with pytest.raises(Exception, match="differ in number"):
        ancestry.zip_q(fam, q.where("row_idx = 0")).collect()
    with pytest.raises(Exception, match="no metadata for B_1"):
        ancestry.admixture_labels(fam, spark.createDataFrame([("0", "A_1_2", "AFR")], "fid string, iid string, supervised_label string")).collect()


def test_last_q_row_of_a_sample_counts(spark):
    rows = spark.createDataFrame([("A", "A_1"), ("A", "A_2")], "pop string, vcf_sample_id string")
    q = spark.createDataFrame([(0, "A", "A_1", 0.1, 0.9), (1, "A", "A_1", 0.3, 0.7)], "row_idx long, pop string, iid string, afr_q double, eur_q double")
    got = {r.vcf_sample_id: r.afr_q for r in ancestry.with_q(rows, q).collect()}
    assert got == {"A_1": 0.3, "A_2": None}


def test_supervised_admixture_finds_the_mixture(spark):
    sites = range(40)
    rows, labels = [], []
    for i in range(10):
        for pop, p in (("AFR", 2), ("EUR", 0)):
            rows += [(f"{pop}{i}", s, p) for s in sites]
            labels.append((f"{pop}{i}", pop))
    rows += [("mix", s, 1) for s in sites] + [("three", s, 2 if s % 4 else 0) for s in sites]
    labels += [("mix", "-"), ("three", "-")]
    got = {r["sample"]: r.afr_q for r in admixture.supervised(spark.createDataFrame(rows, "sample string, site_id int, dosage int"), spark.createDataFrame(labels, "sample string, label string"), iterations=8).collect()}
    assert got["AFR0"] == 1.0 and got["EUR0"] == 0.0 and got["mix"] == pytest.approx(0.5, abs=0.02) and got["three"] == pytest.approx(0.75, abs=0.05)


def test_supervised_admixture_keeps_replicates_apart_and_stops(spark):
    rows = [(rep, f"{pop}{i}", s, p if rep == 1 else 2 - p) for rep in (1, 2) for i in range(6) for pop, p in (("AFR", 2), ("EUR", 0)) for s in range(20)]
    rows += [(rep, "mix", s, 2) for rep in (1, 2) for s in range(20)]
    labels = [(rep, f"{pop}{i}", pop) for rep in (1, 2) for i in range(6) for pop in ("AFR", "EUR")] + [(rep, "mix", "-") for rep in (1, 2)]
    out = admixture.supervised(spark.createDataFrame(rows, "rep int, sample string, site_id int, dosage int"), spark.createDataFrame(labels, "rep int, sample string, label string"), iterations=6, keys=["rep"])
    got = {r.rep: r.afr_q for r in out.where("sample = 'mix'").collect()}
    assert got[1] > 0.97 and got[2] < 0.03


def plain_admixture(g, fixed, low=1e-5, steps=20_000):
    """Expectation-maximisation on one matrix (samples, sites; nan is missing), step by step until nothing moves."""
    held, alt = ~np.isnan(g), np.nan_to_num(g)
    ref, q = np.where(held, 2 - alt, 0), np.where(np.isnan(fixed), 0.5, fixed)
    weigh = lambda w: np.clip((w[:, None] * alt).sum(0) / np.maximum(2 * (w[:, None] * held).sum(0), 1e-12), low, 1 - low)
    pa, pe = weigh(q), weigh(1 - q)
    for _ in range(steps):
        a, e = q[:, None] * pa, (1 - q)[:, None] * pe
        b, f = q[:, None] * (1 - pa), (1 - q)[:, None] * (1 - pe)
        a1, e1, a0, e0 = alt * a / (a + e), alt * e / (a + e), ref * b / (b + f), ref * f / (b + f)
        pa, pe = (np.clip(x.sum(0) / np.maximum((x + y).sum(0), 1e-12), low, 1 - low) for x, y in ((a1, a0), (e1, e0)))
        new = np.where(np.isnan(fixed), (a1 + a0).sum(1) / (alt + ref).sum(1), fixed)
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-13:
            break
    return q


def test_supervised_admixture_equals_plain_steps(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows, labels, want = [], [], {}
    for rep, n_sites in ((1, 150), (2, 60)):
        p = rng.uniform(0.05, 0.95, (2, n_sites))
        fixed = np.array([1.0] * 6 + [0.0] * 6 + [np.nan] * 8)
        truth = np.where(np.isnan(fixed), rng.uniform(0, 1, 20), fixed)
        g = rng.binomial(2, truth[:, None] * p[0] + (1 - truth)[:, None] * p[1]).astype(float)
        g[rng.random(g.shape) < 0.1] = np.nan
        names = [f"s{(7 * i) % 20:02}" for i in range(20)]
        rows += [(rep, names[i], j, int(g[i, j])) for i in range(20) for j in range(n_sites) if not np.isnan(g[i, j])]
        labels += [(rep, n, "-" if np.isnan(f) else "AFR" if f else "EUR") for n, f in zip(names, fixed)]
        want |= {(rep, n): x for n, x in zip(names, plain_admixture(g, fixed))}
    g, known = spark.createDataFrame(rows, "rep int, sample string, site_id int, dosage int"), spark.createDataFrame([*labels, (1, "unseen", "-")], "rep int, sample string, label string")
    monkeypatch.setattr(admixture, "BLOCK_CALLS", 700)  # several blocks of sites
    for sent in (1 << 20, 0):  # proportions are sent to all tasks, or joined to the blocks
        monkeypatch.setattr(admixture, "SENT_BYTES", sent)
        got = admixture.supervised(g, known, keys=["rep"], tolerance=1e-9 if sent else 1e-3).collect()
        assert {(x.rep, x["sample"]) for x in got} == want.keys() and all(x.converged and x.moved <= 1e-3 for x in got)
        assert max(abs(x.afr_q - want[x.rep, x["sample"]]) for x in got) < (1e-6 if sent else 0.05)
    stopped = admixture.supervised(g, known, iterations=1, keys=["rep"], tolerance=1e-9).collect()
    assert not any(x.converged for x in stopped) and min(x.moved for x in stopped) > 1e-9


def test_window_totals_equal_the_sums_of_pairs(spark):
    r = random.Random(3)
    w = [(i, float(a := r.randrange(0, 300)), a + r.choice([0.5, 3.0, 40.0])) for i in range(80)]
    p = [(float(a := r.randrange(20, 250)), a + r.choice([0.25, 1.0, 7.0, 90.0]), r.random() * 100) for _ in range(120)] + [(50.0, 50.0, 9.0)]
    windows, periods = spark.createDataFrame(w, "w int, w_start double, w_end double"), spark.createDataFrame(p, "p_start double, p_end double, value_start double")
    expected = {}
    for i, a, b in w:
        hits = [(s, e, v, min(b, e) - max(a, s)) for s, e, v in p if a < e and s < b and e > s]
        if hits:
            expected[i] = (sum(v * o / (e - s) for s, e, v, o in hits), min(h[0] for h in hits), max(h[1] for h in hits), sum(h[3] for h in hits))
    for width in (5.0, 60.0, 1000.0):
        got = {x.w: (x.total, x.first, x.last, x.observed) for x in intervals.window_totals(windows, periods, "value_start", width).collect()}
        assert got.keys() == expected.keys() and all(got[i] == pytest.approx(expected[i], abs=1e-8) for i in got)
    assert intervals.window_totals(windows, periods.where("false"), "value_start", 5.0).collect() == []


@pytest.mark.parametrize("edges", [1, 3, 63])
def test_quantiles_and_ranks_are_exact_whatever_the_bins(spark, monkeypatch, edges):
    monkeypatch.setattr(summarize, "EDGES", edges)
    r = random.Random(edges)
    groups = {"a": [r.choice([0.0, 1.0, r.random()]) for _ in range(101)], "b": [5.0], "c": [r.expovariate(1) ** 8 for _ in range(60)], "d": [2.0] * 40}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("a", None), ("e", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    places = {(p.g, p.x): (p.n, p.before, p.total) for p in summarize.ranked(df, ["g"], "x").collect()}
    assert places == {(g, v): (values.count(v), sum(y < v for y in values), len(values)) for g, values in groups.items() for v in values}
    for most in (1_000_000, 50):  # counted values of a group in one task, or ranks in bins
        monkeypatch.setattr(summarize, "GROUP_ROWS", most)
        got = {x.g: (x.min, x.q1, x.median, x.mean, x.q3, x.max) for x in summarize.five_numbers(df, ["g"], "x").collect()}
        for g, values in groups.items():
            q = np.quantile(values, [0.25, 0.5, 0.75])
            assert got[g] == pytest.approx((min(values), q[0], q[1], np.mean(values), q[2], max(values)))
        assert "e" not in got
        middle = {x.g: (x.n, x.median) for x in summarize.mean_sd(df, ["g"], "x", with_median=True).collect()}
        assert middle == {g: (len(v), pytest.approx(np.median(v))) for g, v in groups.items()} | {"e": (0, None)}


def test_places_on_a_global_axis(spark):
    rows = [(g, float(v), f"{g}{i}") for g, n in (("b", 30), ("a", 20), ("c", 1)) for i, v in enumerate(range(n))]
    df = spark.createDataFrame(rows, "pop string, v double, id string")
    got = {x.id: x.ind for x in summarize.ordered(df, X.level("pop", ["b", "a", "c"]), "v", "id").collect()}
    expected = sorted(rows, key=lambda x: ("bac".index(x[0]), -x[1], x[2]))
    assert got == {x[2]: n for n, x in enumerate(expected, 1)}
    ends = summarize.ordered_boundaries(df, X.level("pop", ["b", "a", "c"]))
    assert [(x.xmin, x.xmax) for x in ends.orderBy("grp").collect()] == [(1, 30), (31, 50), (51, 51)]
    assert [x.at for x in summarize.separators(ends).orderBy("grp").collect()] == [30.5, 50.5]


def test_histogram_edges_and_empty_bins(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 0.05, 0.0500001, 1.0, 0.1, float("nan"))], "g string, x double")
    got = {r.bin: r["count"] for r in summarize.histogram(df, ["g"], "x", 0.0, 0.05, 20).collect()}
    assert len(got) == 20 and got[1] == 2 and got[2] == 2 and got[20] == 1 and sum(got.values()) == 5


def test_density_integrates_to_one_and_boxes_have_whiskers(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5, 6, 7, 30)], "g string, x double")
    total = summarize.density(df, ["g"], "x", -40.0, 80.0, 600).agg(F.sum("density")).first()[0] * 120 / 599
    assert total == pytest.approx(1, abs=1e-3)
    b = summarize.box(df, ["g"], "x").first()
    assert (b.q1, b.median, b.q3, b.low, b.high) == (2.75, 4.5, 6.25, 1.0, 7.0)


def test_scalars(spark):
    df = spark.createDataFrame([("1,2,,3.5", 5, 0.0, None), ("", 1, -2.0, 1.0)], "s string, n int, x double, y double")
    a, b = df.select(X.float_list("s").alias("l"), X.harmonic("n").alias("h"), X.clamp_low("x", 0).alias("c"), X.divide("y", "x").alias("d"), X.pseudo_log10("x").alias("p"), X.level("s", ["", "z"]).alias("v"), X.number("s").alias("m")).collect()
    assert a.l == [1.0, 2.0, 3.5] and a.h == pytest.approx(25 / 12) and b.h is None and b.c == 0 and a.d is None and b.d == -0.5
    assert b.p == pytest.approx(math.asinh(-1) / math.log(10)) and b.v == 1 and a.v is None and b.m is None


def test_overlaps_and_points(spark):
    w = spark.createDataFrame([(1, 1600.0, 1625.0), (2, 1625.0, 1650.0)], "w int, w_start double, w_end double")
    p = spark.createDataFrame([("a", 1620.0, 1630.0, 10.0, 20.0), ("b", 1630.0, 1640.0, 100.0, 200.0)], "p string, p_start double, p_end double, value_start double, value_end double")
    for width in (3.0, 25.0, 1000.0):
        got = {(r.w, r.p): (r.overlap, r.weight) for r in intervals.overlaps(w, p, width).collect()}
        assert got == {(1, "a"): (5.0, 0.5), (2, "a"): (5.0, 0.5), (2, "b"): (10.0, 1.0)}
        points = spark.createDataFrame([(1620.0,), (1625.0,), (1630.0,), (1640.0,), (1641.0,), (None,)], "y double")
        at = {r.y: r.value for r in intervals.at_point(points, p, "y", width).collect()}
        assert at == {1620.0: 10.0, 1625.0: 15.0, 1630.0: 100.0, 1640.0: 200.0, 1641.0: None, None: None}


def random_calls(spark, sites=40, inds=70, missing=0.0, seed=5):
    """One window of dense sites, individuals over several packed words; some individuals have no call at some sites."""
    r = random.Random(seed)
    rows = [(1, "1", "A", s, float(10 * (s // 2)), 3 * i, h, int(r.random() < 0.2 + 0.5 * (i % 3 == s % 3))) for s in range(sites) for i in range(inds) if r.random() >= missing for h in (1, 2)]
    return spark.createDataFrame(rows, CALLS)


def test_packed_calls_round_trip(spark):
    calls = random_calls(spark, missing=0.2)
    held = packed.sites(calls)
    back = packed.unpacked(held.select(*genotype.SITE, "pop", "codes")).select(*genotype.SITE, "pop", "ind", "dosage")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, genotype.dosages(calls).collect()))
    assert held.agg(F.max(F.size("codes"))).first()[0] == 7  # 70 individuals numbered to 207, 31 a word


@pytest.mark.parametrize("missing", [0.0, 0.25])
def test_dense_windows_are_cut_into_tiles(spark, monkeypatch, missing):
    calls, spans = random_calls(spark, missing=missing), spark.createDataFrame([(1, "1", 1e6)], "rep int, chrom string, span double")
    dosage = {}
    for x in genotype.dosages(calls).collect():
        dosage.setdefault((x.position, x.site_id), {})[x.ind] = x.dosage
    want = {}
    for (p, s), a in dosage.items():
        for (q, t), b in dosage.items():
            if (p, s) < (q, t) and q > p:
                both = [(a[i], b[i]) for i in a if i in b]
                x, y = np.array(both).T if both else (np.zeros(1), np.zeros(1))
                r2 = np.corrcoef(x, y)[0, 1] ** 2 if x.std() and y.std() else None
                cell = want.setdefault(int(q - p - 1) // 50 * 50 + 50, [0.0, 0, 0])
                cell[0] += r2 or 0
                cell[1] += 1
                cell[2] += r2 is not None
    monkeypatch.setattr(ld, "BLOCK", 9)
    got = {x.distance_bin_bp: (x.sum_r2, x.n_pairs, x.n_valid) for x in ld.decay(calls, spans, bin_bp=50, maf=0.0).collect()}
    assert got.keys() == want.keys()
    for k, (total, pairs, valid) in want.items():
        assert got[k][1:] == (pairs, valid) and got[k][0] == pytest.approx(total, abs=1e-9)
    keys = [*genotype.UNIT, "pop", "w"]
    dealt = ld.dealt_tiles(packed.sites(calls).withColumn("w", F.lit(0)), keys, 9)
    sizes = [x["count"] for x in dealt.groupBy(*keys, "i", "j").count().collect()]
    assert len(sizes) == 15 and max(sizes) < 40 and dealt.agg(F.max("blocks")).first()[0] == 5  # no group has the 40 sites


@pytest.mark.parametrize("missing", [0.0, 0.25])
def test_king_over_blocks_of_individuals(spark, monkeypatch, missing):
    calls = random_calls(spark, missing=missing)
    dosage = {}
    for x in genotype.dosages(calls).collect():
        dosage.setdefault(x.ind, {})[x.site_id] = x.dosage
    monkeypatch.setattr(kinship, "IND_BLOCK", 62)
    monkeypatch.setattr(kinship, "SITE_BLOCK", 7)
    got = {(x.ind1, x.ind2): (x.squares, x.het1, x.het2) for x in kinship.king_partials(calls).collect()}
    assert len(got) == 70 * 69 // 2
    for (a, b), found in got.items():
        both = [(x, dosage[b][s]) for s, x in dosage[a].items() if s in dosage[b]]
        assert a < b and found == (sum((x - y) ** 2 for x, y in both), sum(x == 1 for x, _ in both), sum(y == 1 for _, y in both))


def test_king_sums_are_whole_without_a_shuffle_of_pairs(spark, monkeypatch):
    calls = random_calls(spark, missing=0.3)
    by_chrom = kinship.kinship(kinship.king_partials(calls), ["rep", "pop"])
    monkeypatch.setattr(kinship, "IND_BLOCK", 31)
    sums = kinship.king_sums(calls, ["rep", "pop"])
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Aggregate" not in plan[: plan.index("FlatMapGroupsInArrow")]
    got = kinship.kinship_of_sums(sums, ["rep", "pop"])
    assert sorted(map(str, got.collect())) == sorted(map(str, by_chrom.collect()))
    means = {x["sample"]: x.mean_kinship for x in kinship.individual_means(by_chrom, ["rep", "pop"]).collect()}
    assert {x["sample"]: x.mean_kinship for x in kinship.individual_means_of_sums(sums, ["rep", "pop"]).collect()} == pytest.approx(means)


def test_king_has_no_pair_without_a_common_site(spark):
    rows = [(1, "1", "A", s, float(s), i, h, 1) for i, s in ((0, 0), (0, 1), (1, 1), (2, 2)) for h in (1, 2)]
    assert [(x.ind1, x.ind2) for x in kinship.king_partials(spark.createDataFrame(rows, CALLS)).collect()] == [(0, 1)]


@pytest.mark.parametrize("most", [1000, 12, 0])
def test_unrelated_set_of_dense_families(spark, monkeypatch, most):
    r = random.Random(4)
    people = [f"P_{i}" for i in range(30)]
    near = {p: set() for p in people}
    rows = []
    for i, a in enumerate(people):
        for b in people[i + 1 :]:
            close = i < 20 and int(b[2:]) < 20 and r.random() < 0.6
            rows.append((1, "P", a, b, 0.3 if close else 0.0))
            if close:
                near[a].add(b)
                near[b].add(a)
    while any(near.values()):
        worst = min(near, key=lambda p: (-len(near[p]), p))
        for b in near.pop(worst):
            near[b].discard(worst)
    monkeypatch.setattr(kinship, "FAMILY_SAMPLES", most)
    monkeypatch.setattr(kinship, "FAMILY_PAIRS", 20)
    looked, families = [], kinship.families
    monkeypatch.setattr(kinship, "families", lambda *a: looked.append(1) or families(*a))
    got = kinship.unrelated_set(spark.createDataFrame(rows, "rep int, pop string, sample1 string, sample2 string, kinship double"), ["rep", "pop"])
    assert {x["sample"] for x in got.collect()} == set(near)
    assert most < 30 or not looked  # one group, no rounds


def test_dense_joint_spectra_shuffle_no_cells(spark):
    rows = [(1, c, p, s, float(s), i, h, int((i + s) % 3 == 0)) for c, most in (("1", 3), ("2", 4)) for p in ("AFR", "EUR") for i in range(most + (p == "EUR")) for s in range(4) for h in (1, 2)]
    calls = spark.createDataFrame(rows, CALLS)
    by_chrom = sfs.add_up(sfs.sfs_2d_dense(calls, ["AFR", "EUR"]), ["rep", "pop1", "pop2", "pop1_count", "pop2_count"])
    genome = sfs.sfs_2d_dense(calls, ["AFR", "EUR"], ["rep"])
    got = sorted(map(tuple, genome.collect()))
    assert got == sorted(map(tuple, by_chrom.collect())) and len(got) == 9 * 11 and sum(x[-1] for x in got) == 8
    plan = genome._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.rindex("array_except")].split("Generate", 1)[0]


def test_overlaps_of_crowded_cells(spark, monkeypatch):
    r = random.Random(6)
    windows = [(i, float(a := r.randrange(40)), float(a + r.randrange(0, 9))) for i in range(60)] * 2
    periods = [(i, float(a := r.randrange(40)), float(a + r.randrange(1, 9))) for i in range(50)]
    monkeypatch.setattr(intervals, "SIDE", 3)
    monkeypatch.setattr(intervals, "TASK_PAIRS", 100)
    found = intervals.overlaps(spark.createDataFrame(windows, "w int, w_start double, w_end double"), spark.createDataFrame(periods, "p int, p_start double, p_end double"), 16.0)
    assert found.columns == ["w", "w_start", "w_end", "p", "p_start", "p_end", "overlap", "weight"]
    want = sorted((w, p, min(b, d) - max(a, c)) for w, a, b in windows for p, c, d in periods if a < d and c < b)
    assert sorted((x.w, x.p, x.overlap) for x in found.collect()) == want
    assert found.rdd.getNumPartitions() > 20  # as many tasks as the pairs need, whatever the rows' size
