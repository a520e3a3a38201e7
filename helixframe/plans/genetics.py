"""Queries on genotypes, kinship and ancestry: (Spark plan, the same rows in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admixture, ancestry, diversity, genotype, kinship, ld, sfs
from ..sources import adapters as A
from ..sources.checkpoints import cut

r = lambda df, *cols, n=8: df.withColumns({c: F.round(c, n) for c in cols})

CALLS = """persons AS (
  SELECT vec_id // 2 AS pair, arg_min(label, vec_id) AS label FROM embeddings GROUP BY vec_id // 2 HAVING count(*) = 2
), long AS (
  SELECT vec_id, pair, label, unnest(generate_series(0, 63)) AS s, unnest(embedding) AS x FROM (SELECT vec_id, embedding, vec_id // 2 AS pair FROM embeddings) JOIN persons USING (pair)
), calls AS MATERIALIZED (
  SELECT CAST(1 + pair % 2 AS INT) AS rep, CAST(1 + s // 16 AS VARCHAR) AS chrom, CASE WHEN label <= 2 THEN 'AFR' WHEN label <= 5 THEN 'EUR' ELSE 'ADX' END AS pop, CAST(s AS INT) AS site_id, CAST((s % 16 + 1) * 1000 AS DOUBLE) AS position,
    CAST(pair // 2 AS INT) AS ind, CAST(vec_id % 2 + 1 AS INT) AS hap, CASE WHEN CAST(x AS DOUBLE) > 0.05e0 * (s % 8) THEN 1 ELSE 0 END AS allele FROM long
), spans AS (
  SELECT DISTINCT rep, chrom, CAST(16000 + 1000 * CAST(chrom AS INT) AS DOUBLE) AS span FROM calls
)"""
MAF = """maf AS (
  SELECT rep, chrom, site_id, position, least(sum(allele) / count(*), 1 - sum(allele) / count(*)) AS maf FROM calls GROUP BY ALL
)"""
COUNTS = """carried AS (
  SELECT rep, chrom, site_id, pop, sum(allele) AS dac, count(*) AS n FROM calls GROUP BY ALL
), dac AS MATERIALIZED (
  SELECT c.* FROM carried c WHERE EXISTS (SELECT 1 FROM carried o WHERE o.rep = c.rep AND o.chrom = c.chrom AND o.site_id = c.site_id AND o.dac > 0)
)"""
SFS = "sfs AS (SELECT rep, chrom, pop, CAST(dac AS INT) AS derived_allele_count, CAST(count(*) AS DOUBLE) AS count FROM dac GROUP BY ALL)"
SFS2 = """sfs2 AS (
  SELECT a.rep, a.chrom, a.pop AS pop1, b.pop AS pop2, CAST(a.dac AS INT) AS pop1_count, CAST(b.dac AS INT) AS pop2_count, CAST(count(*) AS DOUBLE) AS count
  FROM dac a JOIN dac b USING (rep, chrom, site_id) WHERE (a.pop, b.pop) IN (('AFR', 'EUR'), ('AFR', 'ADX'), ('EUR', 'ADX')) GROUP BY ALL
)"""
PI = """by_site AS (
  SELECT rep, chrom, pop, site_id, sum(x) AS n, sum(x * (x - 1)) AS same, count(*) AS alleles FROM (SELECT rep, chrom, pop, site_id, allele, count(*) AS x FROM calls GROUP BY ALL) GROUP BY ALL
), sums AS (
  SELECT rep, chrom, pop, sum(1 - CAST(same AS DOUBLE) / (n * (n - 1))) AS pi_sum, CAST(sum(alleles - 1) AS DOUBLE) AS s_sum, max(n) AS n FROM by_site GROUP BY ALL
), whole AS (
  SELECT *, list_sum(list_transform(generate_series(1, CAST(n - 1 AS INT)), lambda i: 1e0 / i)) AS a_n FROM sums JOIN spans USING (rep, chrom)
), pi AS (
  SELECT rep, chrom, pop, 'pi' AS stat, pi_sum / span AS value, CAST(NULL AS DOUBLE) AS segregating_sites, span, a_n AS wattersons_const FROM whole
  UNION ALL SELECT rep, chrom, pop, 'theta', s_sum / span / a_n, s_sum / span, span, a_n FROM whole
)"""
PAIRS = """dos AS (
  SELECT rep, chrom, pop, site_id, position, ind, sum(allele) AS g FROM calls GROUP BY ALL
), kept AS (
  SELECT d.* FROM dos d JOIN (SELECT rep, chrom, site_id FROM maf WHERE maf >= {maf}) USING (rep, chrom, site_id)
), moments AS (
  SELECT rep, chrom, pop, a.position AS pa, b.position AS pb, count(*) AS n, sum(a.g * b.g) AS xy, sum(a.g) AS x, sum(b.g) AS y, sum(a.g * a.g) AS xx, sum(b.g * b.g) AS yy
  FROM kept a JOIN kept b USING (rep, chrom, pop, ind) WHERE a.site_id < b.site_id AND b.position > a.position GROUP BY ALL
), r2 AS (
  SELECT rep, chrom, pop, ((CAST(pb - pa AS BIGINT) - 1) // 5000 + 1) * 5000 AS distance_bin_bp,
    CASE WHEN (n * xx - x * x) * (n * yy - y * y) > 0 THEN CAST(n * xy - x * y AS DOUBLE) * CAST(n * xy - x * y AS DOUBLE) / CAST((n * xx - x * x) * (n * yy - y * y) AS DOUBLE) END AS r2 FROM moments
), decay AS (
  SELECT rep, chrom, pop, CAST(0 AS BIGINT) AS window_start, CAST(span AS BIGINT) AS window_end, CAST(distance_bin_bp AS BIGINT) AS distance_bin_bp, avg(r2) AS mean_r2, coalesce(sum(r2), 0) AS sum_r2, count(*) AS n_pairs, count(r2) AS n_valid
  FROM r2 JOIN spans USING (rep, chrom) GROUP BY ALL
)"""
KING = """dos AS (
  SELECT rep, chrom, pop, site_id, ind, sum(allele) AS g FROM calls GROUP BY ALL
), parts AS MATERIALIZED (
  SELECT rep, chrom, pop, a.ind AS ind1, b.ind AS ind2, CAST(sum((a.g - b.g) * (a.g - b.g)) AS BIGINT) AS squares, count(*) FILTER (a.g = 1) AS het1, count(*) FILTER (b.g = 1) AS het2
  FROM dos a JOIN dos b USING (rep, chrom, pop, site_id) WHERE a.ind < b.ind GROUP BY ALL
), king AS MATERIALIZED (
  SELECT rep, pop, pop || '_' || (ind1 + 1) AS sample1, pop || '_' || (ind2 + 1) AS sample2,
    CASE WHEN least(sum(het1), sum(het2)) > 0 THEN 0.5e0 - sum(squares) / CAST(4 * least(sum(het1), sum(het2)) AS DOUBLE) END AS kinship
  FROM parts GROUP BY rep, pop, ind1, ind2
)"""
SEGMENTS = """e AS (
  SELECT user_id, event_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS "left", event_type FROM events
), segments AS (
  SELECT user_id AS node, user_id // 2 AS ind, (['AFR', 'EUR', 'ADX'])[user_id % 3 + 1] AS pop, "left", lead("left") OVER (PARTITION BY user_id ORDER BY "left", event_id) AS "right",
    CASE WHEN event_type IN ('click', 'view') THEN 0 WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 2 END AS population, event_id AS ancestor FROM e
), segs AS MATERIALIZED (
  SELECT s.*, pop || '_' || (ind + 1) AS sample_id, pop || '_' || (ind - first + 1) AS vcf_sample_id
  FROM (SELECT * FROM segments WHERE "right" IS NOT NULL) s JOIN (SELECT pop, min(ind) AS first FROM segments WHERE "right" IS NOT NULL GROUP BY pop) USING (pop)
)"""
FAM = """fam AS (
  SELECT c_custkey AS row_idx, '0' AS fid, (['AFR', 'EUR', 'ADX'])[c_nationkey % 3 + 1] AS pop, pop || '_' || c_custkey AS iid FROM customer
), q AS (
  SELECT c_custkey AS row_idx, c_custkey * 37 % 101 / 100e0 AS afr_q, 1 - c_custkey * 37 % 101 / 100e0 AS eur_q FROM customer
)"""
VARIANTS = """variants AS (
  SELECT CAST(l_suppkey % 22 + 1 AS VARCHAR) AS chrom, l_partkey * 10 + l_linenumber AS position, (['A', 'C', 'G', 'T', 'AC'])[l_partkey % 5 + 1] AS ref,
    (['A', 'C', 'G', 'T', 'AC'])[l_orderkey % 5 + 1] || CASE WHEN l_quantity > 45 THEN ',T' ELSE '' END AS alt,
    (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS file_order FROM lineitem
)"""


def _decay(s, d, maf=ld.MAF):
    return ld.decay(A.calls(s, d), A.spans(s, d), maf=maf)


def _king_sums(s, d):
    return kinship.king_sums(A.calls(s, d), ["rep", "pop"])


def _king(s, d):
    return kinship.kinship_of_sums(_king_sums(s, d), ["rep", "pop"])


def _q(s, d):
    return ancestry.zip_q(A.fam(s, d).drop("pop"), A.q(s, d))


def _ancestry_rows(s, d):
    g = ancestry.global_ancestry(A.segments(s, d))
    return g.select(F.lit(1).alias("rep"), "pop", "sample_id", "vcf_sample_id", F.col("afr_prop").alias("afr_tspop"), F.col("eur_prop").alias("eur_tspop"), "span")


def _by_chrom(s, d):
    g = ancestry.global_ancestry(A.segments(s, d).withColumn("chrom", (F.col("ancestor") % 4).cast("string")), by=("chrom",))
    return g.select(F.lit(1).alias("rep"), "pop", "chrom", "sample_id", "vcf_sample_id", F.col("afr_prop").alias("afr_tspop"), F.col("eur_prop").alias("eur_tspop"), "span")


def _unrelated_calls(s, d):
    """Calls of the samples of all populations that stay after the relatedness cut-off, in each replicate."""
    kept = kinship.unrelated_set(_king(s, d), ["rep", "pop"]).select("rep", "pop", (F.split_part("sample", F.lit("_"), F.lit(2)).cast("int") - 1).alias("ind"))
    return A.calls(s, d).join(cut(kept), ["rep", "pop", "ind"], "left_semi")  # few rows, read several times


def _pruned(s, d, calls):
    """Sites left by pruning the unrelated samples of all populations together."""
    together = calls.select("rep", "chrom", "site_id", "position", F.lit("all").alias("pop"), F.struct("pop", "ind").alias("ind"), "hap", "allele")
    return ld.prune(ld.wide(together, ld.MAF))


def _admixture(s, d):
    calls = _unrelated_calls(s, d)
    sites = _pruned(s, d, calls).select("rep", "site_id")
    sample = F.concat_ws("_", "pop", "ind").alias("sample")
    genotypes = cut(genotype.dosages(calls).select("rep", "pop", sample, "site_id", "dosage")).join(F.broadcast(cut(sites)), ["rep", "site_id"], "left_semi")
    labels = genotypes.select("rep", "sample", F.when(F.col("pop") == "ADX", "-").otherwise(F.col("pop")).alias("label")).distinct()
    return admixture.supervised(genotypes.drop("pop"), labels, keys=["rep"])


def _decay_sql(maf: str = "0.1e0") -> str:
    return f"WITH {CALLS}, {MAF}, {PAIRS.format(maf=maf)}"


ROUND_DECAY = "SELECT rep, chrom, pop, window_start, window_end, distance_bin_bp, round(mean_r2, 8) AS mean_r2, round(sum_r2, 8) AS sum_r2, n_pairs, n_valid FROM decay"
GLOBAL_SQL = """summed AS (
  SELECT pop, sample_id, vcf_sample_id, sum("right" - "left") FILTER (population = 0) AS a, sum("right" - "left") FILTER (population = 1) AS e FROM segs {where} GROUP BY ALL
), shares AS (
  SELECT pop, sample_id, vcf_sample_id, coalesce(a, 0) + coalesce(e, 0) AS span, coalesce(a, 0) / nullif(coalesce(a, 0) + coalesce(e, 0), 0) AS afr, coalesce(e, 0) / nullif(coalesce(a, 0) + coalesce(e, 0), 0) AS eur FROM summed
)"""

PLANS = {
    "sfs_1d": (lambda s, d: sfs.sfs_1d(A.calls(s, d)), f"WITH {CALLS}, {COUNTS}, {SFS} SELECT * FROM sfs"),
    "sfs_dense": (
        lambda s, d: sfs.sfs_dense(A.calls(s, d)),
        f"""WITH {CALLS}, {COUNTS}, {SFS}, grid AS (SELECT rep, chrom, pop, CAST(unnest(generate_series(0, n)) AS INT) AS derived_allele_count FROM (SELECT rep, chrom, pop, max(n) AS n FROM carried GROUP BY ALL))
        SELECT g.*, coalesce(s.count, 0e0) AS count FROM grid g LEFT JOIN sfs s USING (rep, chrom, pop, derived_allele_count)""",
    ),
    "sfs_2d": (lambda s, d: sfs.sfs_2d(A.calls(s, d), A.POPS), f"WITH {CALLS}, {COUNTS}, {SFS2} SELECT * FROM sfs2"),
    "sfs_2d_dense": (
        lambda s, d: sfs.sfs_2d_dense(A.calls(s, d), A.POPS, ["rep"]),
        f"""WITH {CALLS}, {COUNTS}, {SFS2}, sizes AS (SELECT rep, chrom, pop, max(n) AS n FROM carried GROUP BY ALL),
        side AS (SELECT rep, chrom, pop, CAST(unnest(generate_series(0, n)) AS INT) AS c FROM sizes),
        grid AS (SELECT a.rep, a.chrom, a.pop AS pop1, b.pop AS pop2, a.c AS pop1_count, b.c AS pop2_count FROM side a JOIN side b USING (rep, chrom) WHERE (a.pop, b.pop) IN (('AFR', 'EUR'), ('AFR', 'ADX'), ('EUR', 'ADX')))
        SELECT g.rep, g.pop1, g.pop2, g.pop1_count, g.pop2_count, sum(coalesce(s.count, 0e0)) AS count FROM grid g LEFT JOIN sfs2 s USING (rep, chrom, pop1, pop2, pop1_count, pop2_count) GROUP BY ALL""",
    ),
    "sfs_genome": (lambda s, d: sfs.add_up(sfs.sfs_1d(A.calls(s, d)), ["rep", "pop", "derived_allele_count"]), f"WITH {CALLS}, {COUNTS}, {SFS} SELECT rep, pop, derived_allele_count, sum(count) AS count FROM sfs GROUP BY ALL"),
    "sfs2d_genome": (
        lambda s, d: sfs.add_up(sfs.sfs_2d(A.calls(s, d), A.POPS), ["rep", "pop1", "pop2", "pop1_count", "pop2_count"]),
        f"WITH {CALLS}, {COUNTS}, {SFS2} SELECT rep, pop1, pop2, pop1_count, pop2_count, sum(count) AS count FROM sfs2 GROUP BY ALL",
    ),
    "allele_counts": (
        lambda s, d: genotype.allele_counts(A.calls(s, d)),
        f"WITH {CALLS} SELECT rep, chrom, site_id, position, pop, count(*) AS n_called, count(*) FILTER (allele = 1) AS n_alt, count(*) FILTER (allele > 0) AS n_derived FROM calls GROUP BY ALL",
    ),
    "maf_filter": (
        lambda s, d: r(genotype.pooled_maf(genotype.maf_filter(A.calls(s, d))), "maf"),
        f"WITH {CALLS}, {MAF} SELECT rep, chrom, site_id, position, round(maf, 8) AS maf FROM maf WHERE maf >= 0.1e0",
    ),
    "dosages": (lambda s, d: genotype.dosages(A.calls(s, d)), f"WITH {CALLS} SELECT rep, chrom, site_id, position, pop, ind, CAST(sum(allele) AS INT) AS dosage FROM calls GROUP BY ALL"),
    "pi_theta_chrom": (
        lambda s, d: diversity.pi_theta(A.calls(s, d), A.spans(s, d)).select("rep", "chrom", "pop", "stat", *[F.round(c, 10).alias(c) for c in ("value", "segregating_sites", "wattersons_const")], F.round("ne_value", 2).alias("ne_value"), "mutation_rate", "span"),
        f"""WITH {CALLS}, {PI} SELECT rep, chrom, pop, stat, round(value, 10) AS value, round(segregating_sites, 10) AS segregating_sites, round(wattersons_const, 10) AS wattersons_const,
        round(value / (4 * 2.36e-8), 2) AS ne_value, 2.36e-8 AS mutation_rate, span FROM pi""",
    ),
    "pi_theta_genome": (
        lambda s, d: diversity.genome_pi_theta(diversity.pi_theta(A.calls(s, d), A.spans(s, d)), diversity.haplotypes_by_pop(A.fam(s, d))).select("rep", "pop", "stat", *[F.round(c, 10).alias(c) for c in ("value", "segregating_sites", "wattersons_const")], F.round("ne_value", 2).alias("ne_value")),
        f"""WITH {CALLS}, {PI}, {FAM}, h AS (SELECT pop, count(*) * 2 AS h FROM fam GROUP BY pop),
        g AS (SELECT rep, pop, stat, sum(value * span) / sum(span) AS m, sum(segregating_sites * span) / sum(span) AS s, arg_min(wattersons_const, chrom) AS a FROM pi GROUP BY ALL),
        t AS (SELECT rep, pop, stat, CASE WHEN stat = 'pi' THEN m * h / (h - 1) ELSE s / a END AS value, CASE WHEN stat = 'theta' THEN s END AS s, CASE WHEN stat = 'theta' THEN a END AS a FROM g JOIN h USING (pop))
        SELECT rep, pop, stat, round(value, 10) AS value, round(s, 10) AS segregating_sites, round(a, 10) AS wattersons_const, round(value / (4 * 2.36e-8), 2) AS ne_value FROM t""",
    ),
    "ld_decay_chrom": (lambda s, d: r(_decay(s, d), "mean_r2", "sum_r2"), f"{_decay_sql()} {ROUND_DECAY}"),
    "ld_decay_unfiltered": (lambda s, d: r(_decay(s, d, 0.0), "mean_r2", "sum_r2"), f"{_decay_sql('0e0')} {ROUND_DECAY}"),
    "ld_decay_genome": (
        lambda s, d: r(ld.reaggregate(_decay(s, d), ["rep", "pop", "distance_bin_bp"]), "mean_r2", "sum_r2"),
        f"{_decay_sql()} SELECT rep, pop, distance_bin_bp, round(sum(sum_r2), 8) AS sum_r2, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, round(sum(sum_r2) / sum(n_pairs), 8) AS mean_r2 FROM decay GROUP BY ALL",
    ),
    "king_partials": (lambda s, d: kinship.king_partials(A.calls(s, d)), f"WITH {CALLS}, {KING} SELECT rep, chrom, pop, ind1, ind2, squares, het1, het2 FROM parts"),
    "king_kinship": (lambda s, d: r(_king(s, d), "kinship"), f"WITH {CALLS}, {KING} SELECT rep, pop, sample1, sample2, round(kinship, 8) AS kinship FROM king"),
    "king_kinship_chrom": (
        lambda s, d: r(kinship.kinship_of_sums(kinship.king_partials(A.calls(s, d)), ["rep", "chrom", "pop"]), "kinship"),
        f"""WITH {CALLS}, {KING} SELECT rep, chrom, pop, pop || '_' || (ind1 + 1) AS sample1, pop || '_' || (ind2 + 1) AS sample2,
        round(CASE WHEN least(het1, het2) > 0 THEN 0.5e0 - squares / CAST(4 * least(het1, het2) AS DOUBLE) END, 8) AS kinship FROM parts""",
    ),
    "individual_mean_kinship": (
        lambda s, d: r(kinship.individual_means_of_sums(_king_sums(s, d), ["rep", "pop"]), "mean_kinship"),
        f"WITH {CALLS}, {KING} SELECT rep, pop, sample, round(avg(kinship), 8) AS mean_kinship FROM (SELECT rep, pop, sample1 AS sample, kinship FROM king UNION ALL SELECT rep, pop, sample2, kinship FROM king) GROUP BY ALL",
    ),
    "symmetric_pairs": (
        lambda s, d: r(kinship.both_ways(_king(s, d)), "kinship"),
        f"WITH {CALLS}, {KING} SELECT rep, pop, sample1, sample2, round(kinship, 8) AS kinship FROM king UNION ALL SELECT rep, pop, sample2, sample1, round(kinship, 8) FROM king",
    ),
    "unrelated_set": (lambda s, d: kinship.unrelated_set(_king(s, d), ["rep", "pop"]), None),
    "unrelated_pairs": (lambda s, d: r(kinship.among(_king(s, d), kinship.unrelated_set(_king(s, d), ["rep", "pop"]), ["rep", "pop"]), "kinship"), None),
    "ld_prune": (lambda s, d: _pruned(s, d, _unrelated_calls(s, d)), None),
    "admixture_em": (_admixture, None),
    "global_ancestry": (
        lambda s, d: r(ancestry.global_ancestry(A.segments(s, d)), "afr_prop", "eur_prop"),
        f"WITH {SEGMENTS}, {GLOBAL_SQL.format(where='')} SELECT pop, sample_id, vcf_sample_id, round(afr, 8) AS afr_prop, round(eur, 8) AS eur_prop, span FROM shares",
    ),
    "local_ancestry": (
        lambda s, d: ancestry.local_ancestry(A.segments(s, d), "1"),
        f"""WITH {SEGMENTS} SELECT 'chr1' AS chrom, "left", "right", sample_id, vcf_sample_id, CAST(dense_rank() OVER (PARTITION BY pop, ind ORDER BY node) AS INT) AS hap,
        (['AFR', 'EUR', 'ADX'])[population + 1] AS population_name, CAST(population AS INT) AS population, ancestor FROM segs""",
    ),
    "genome_ancestry_weighted": (
        lambda s, d: r(ancestry.genome_ancestry(_by_chrom(s, d)), "afr_tspop", "eur_tspop"),
        f"""WITH {SEGMENTS}, firsts AS (SELECT ancestor % 4 AS chrom, pop, min(ind) AS f FROM segs GROUP BY ALL),
        g AS (SELECT s.pop, s.ancestor % 4 AS chrom, s.pop || '_' || (s.ind + 1) AS sample_id, s.pop || '_' || (s.ind - f.f + 1) AS vcf_sample_id,
          coalesce(sum("right" - "left") FILTER (population = 0), 0) AS a, coalesce(sum("right" - "left") FILTER (population = 1), 0) AS e FROM segs s JOIN firsts f ON f.chrom = s.ancestor % 4 AND f.pop = s.pop GROUP BY ALL),
        p AS (SELECT *, a + e AS span, a / nullif(a + e, 0) AS afr, e / nullif(a + e, 0) AS eur FROM g)
        SELECT CAST(1 AS INT) AS rep, pop, sample_id, vcf_sample_id, round(sum(afr * span) / nullif(sum(span), 0), 8) AS afr_tspop, round(sum(eur * span) / nullif(sum(span), 0), 8) AS eur_tspop, sum(span) AS span FROM p GROUP BY pop, sample_id, vcf_sample_id""",
    ),
    "ancestry_q_left_join": (
        lambda s, d: r(ancestry.with_q(_ancestry_rows(s, d), _q(s, d)), "afr_tspop", "eur_tspop", "afr_q", "eur_q"),
        f"""WITH {SEGMENTS}, {GLOBAL_SQL.format(where='')}, {FAM} SELECT CAST(1 AS INT) AS rep, s.pop, sample_id, vcf_sample_id, round(afr, 8) AS afr_tspop, round(eur, 8) AS eur_tspop, span, round(q.afr_q, 8) AS afr_q, round(q.eur_q, 8) AS eur_q
        FROM shares s LEFT JOIN (SELECT pop, iid, afr_q, eur_q FROM fam JOIN q USING (row_idx)) q ON s.pop = q.pop AND s.vcf_sample_id = q.iid""",
    ),
    "fam_q_zip": (lambda s, d: r(_q(s, d), "afr_q", "eur_q"), f"WITH {FAM} SELECT row_idx, pop, iid, round(afr_q, 8) AS afr_q, round(eur_q, 8) AS eur_q FROM fam JOIN q USING (row_idx)"),
    "metadata_labels": (
        lambda s, d: ancestry.admixture_labels(A.fam(s, d).drop("pop"), A.fam(s, d).select("fid", "iid", F.when(F.col("pop") == "ADX", "-").otherwise(F.col("pop")).alias("supervised_label"))),
        f"WITH {FAM} SELECT row_idx, fid, iid, CASE WHEN pop = 'ADX' THEN '-' ELSE pop END AS supervised_label FROM fam",
    ),
    "haplotypes_by_pop": (lambda s, d: diversity.haplotypes_by_pop(A.fam(s, d)), f"WITH {FAM} SELECT pop, count(*) * 2 AS haplotypes FROM fam GROUP BY pop"),
    "rm_dup_first": (
        lambda s, d: genotype.drop_duplicate_positions(A.variants(s, d)).select("chrom", "position", "ref", "alt"),
        f"WITH {VARIANTS} SELECT chrom, position, ref, alt FROM variants QUALIFY row_number() OVER (PARTITION BY chrom, position ORDER BY file_order) = 1",
    ),
    "biallelic_variant_id": (
        lambda s, d: genotype.biallelic_snps(A.variants(s, d)).select(genotype_id().alias("id"), "chrom", "position"),
        f"WITH {VARIANTS} SELECT concat_ws(':', chrom, position, ref, alt) AS id, chrom, position FROM variants WHERE length(ref) = 1 AND length(alt) = 1",
    ),
    "keep_extract_semi": (
        lambda s, d: genotype.keep(A.variants(s, d), A.variants(s, d).where("position % 7 = 0").select("chrom", "position"), ["chrom", "position"]).groupBy("chrom").agg(F.count("*").alias("n")),
        f"WITH {VARIANTS} SELECT chrom, count(*) AS n FROM variants WHERE position % 7 = 0 GROUP BY chrom",
    ),
}


def genotype_id():
    from ..functions.scalar import variant_id

    return variant_id("chrom", "position", "ref", "alt")
