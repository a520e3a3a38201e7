"""Across-replicate summaries, intervals and combination checks: (Spark plan, the same rows in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import intervals, kinship, ld, ne_model, sfs, summarize
from ..sources import adapters as A
from ..sources import tables
from .genetics import CALLS, COUNTS, FAM, MAF, PAIRS, SFS, r

CHROM_LEVELS = [str(i) for i in range(1, 23)]
STATS = """st AS (
  SELECT l_linenumber AS rep, l_returnflag AS pop, CAST(l_suppkey % 22 + 1 AS VARCHAR) AS chrom, CAST(l_quantity * 5000 AS BIGINT) AS distance_bin_bp, l_discount AS sum_r2,
    CAST(l_quantity AS BIGINT) AS n_pairs, CAST(l_quantity AS INT) AS derived_allele_count, l_tax AS value, round(l_extendedprice) AS count, l_linestatus AS pop2, CAST(l_partkey % 50 AS INT) AS other_count FROM lineitem
)"""
KIN = """kin AS (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS rep, o_orderstatus AS pop, o_orderstatus || '_' || o_custkey AS sample1, o_orderstatus || '_' || (o_custkey + o_orderkey * 7 % 100 + 1) AS sample2,
    round(o_totalprice) / 4000000 - 0.05e0 AS kinship FROM orders
)"""
HIST = """placed AS (SELECT {by}, greatest(CAST(ceil(({x} - {low}) / {w} - 1e-7) AS INT), 1) AS bin FROM {src}),
counts AS (SELECT {by}, bin, count(*) AS n FROM placed GROUP BY ALL),
grid AS (SELECT {by}, count(*) AS total, unnest(generate_series(1, {bins})) AS bin FROM placed GROUP BY {by}),
hist AS (SELECT {by}, CAST(bin AS INT) AS bin, round({low} + (bin - 1) * {w}, 8) AS xmin, round({low} + bin * {w}, 8) AS xmax, round({low} + (bin - 0.5e0) * {w}, 8) AS xmid, coalesce(n, 0) AS count, round(coalesce(n, 0) / CAST(total AS DOUBLE), 8) AS frac
  FROM grid LEFT JOIN counts USING ({by}, bin))"""
KDE = """b AS (SELECT rep, pop, stddev_samp(kinship) AS sd, quantile_cont(kinship, 0.75) - quantile_cont(kinship, 0.25) AS iqr, count(*) AS n FROM kin GROUP BY ALL),
bw AS (SELECT rep, pop, n, 0.9e0 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34e0) ELSE sd END * pow(n, -0.2e0) AS bw FROM b),
points AS (SELECT k.*, bw.n, bw.bw, unnest(generate_series(0, {last})) AS k FROM kin k JOIN bw USING (rep, pop) WHERE bw > 0)"""
PERIODS = """w AS (SELECT o_orderkey AS w, CAST(epoch_us(o_orderdate) // 86400000000 AS DOUBLE) AS w_start, CAST(epoch_us(o_orderdate) // 86400000000 AS DOUBLE) + 1 + o_orderkey % 30 AS w_end FROM orders),
p AS (SELECT event_id AS p, CAST(epoch_us(ts) // 86400000000 AS DOUBLE) - 11500 + event_id % 2500 AS p_start, CAST(epoch_us(ts) // 86400000000 AS DOUBLE) - 11500 + event_id % 2500 + 1 + event_id % 9 AS p_end, value AS value_start, value + event_id % 5 AS value_end FROM events)"""


def _stats(s, d):
    return A.statistics(s, d)


def _days(x):
    return F.expr(f"unix_micros(CAST({x} AS TIMESTAMP)) div 86400000000").cast("double")


def _windows(s, d):
    start = _days("o_orderdate")
    return A.table(s, d, "orders").select(F.col("o_orderkey").alias("w"), start.alias("w_start"), (start + 1 + F.col("o_orderkey") % 30).alias("w_end"))


def _periods(s, d):
    start = _days("ts") - 11500 + F.col("event_id") % 2500
    return A.table(s, d, "events").select(F.col("event_id").alias("p"), start.alias("p_start"), (start + 1 + F.col("event_id") % 9).alias("p_end"), F.col("value").alias("value_start"), (F.col("value") + F.col("event_id") % 5).alias("value_end"))


def _overlaps(s, d):
    return intervals.overlaps(_windows(s, d), _periods(s, d), 16.0)


def _sites(s, d):
    return sfs.sfs_1d(A.calls(s, d)).where("derived_allele_count > 0")


def _q_long(s, d):
    joined = A.fam(s, d).join(A.q(s, d), "row_idx")
    return joined.unpivot(["row_idx", "pop"], ["afr_q", "eur_q"], "source", "share")


PLANS = {
    "ld_reaggregate": (
        lambda s, d: r(ld.reaggregate(_stats(s, d), ["rep", "pop", "distance_bin_bp"]), "sum_r2", "mean_r2", n=6),
        f"WITH {STATS} SELECT rep, pop, distance_bin_bp, round(sum(sum_r2), 6) AS sum_r2, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, round(sum(sum_r2) / sum(n_pairs), 6) AS mean_r2 FROM st GROUP BY ALL",
    ),
    "sfs_reaggregate": (
        lambda s, d: sfs.add_up(_stats(s, d), ["rep", "pop", "derived_allele_count"]),
        f"WITH {STATS} SELECT rep, pop, derived_allele_count, sum(count) AS count FROM st GROUP BY ALL",
    ),
    "sfs2d_reaggregate": (
        lambda s, d: sfs.add_up(_stats(s, d), ["rep", "pop", "pop2", "derived_allele_count", "other_count"]),
        f"WITH {STATS} SELECT rep, pop, pop2, derived_allele_count, other_count, sum(count) AS count FROM st GROUP BY ALL",
    ),
    "mean_sd_by_group": (
        lambda s, d: r(summarize.mean_sd(_stats(s, d), ["pop", "chrom", "rep"], "value", with_median=True, bands=2, floor=0.0), "mean", "sd", "median", "low", "high"),
        f"""WITH {STATS}, m AS (SELECT pop, chrom, rep, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n, median(value) AS median FROM st GROUP BY ALL)
        SELECT pop, chrom, rep, n, round(mean, 8) AS mean, round(sd, 8) AS sd, round(median, 8) AS median, round(CASE WHEN mean - 2 * sd < 0 THEN 0 ELSE mean - 2 * sd END, 8) AS low, round(mean + 2 * sd, 8) AS high FROM m""",
    ),
    "median_of_means": (
        lambda s, d: r(summarize.median_of_means(_stats(s, d), ["rep", "chrom", "pop"], ["chrom", "pop"], "value"), "median_mean", "median_sd"),
        f"WITH {STATS}, m AS (SELECT rep, chrom, pop, avg(value) AS mean, stddev_samp(value) AS sd FROM st GROUP BY ALL) SELECT chrom, pop, round(median(mean), 8) AS median_mean, round(median(sd), 8) AS median_sd FROM m GROUP BY ALL",
    ),
    "mean_ci": (
        lambda s, d: r(summarize.confidence(ld.reaggregate(_stats(s, d), ["rep", "pop", "distance_bin_bp"]).where(F.col("distance_bin_bp").between(20000, 200000)), ["pop", "distance_bin_bp"], "mean_r2"), "mean", "sd", "se", "ci_low", "ci_high"),
        f"""WITH {STATS}, g AS (SELECT rep, pop, distance_bin_bp, sum(sum_r2) / sum(n_pairs) AS v FROM st WHERE distance_bin_bp BETWEEN 20000 AND 200000 GROUP BY ALL),
        m AS (SELECT pop, distance_bin_bp, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS n FROM g GROUP BY ALL)
        SELECT pop, distance_bin_bp, n, round(mean, 8) AS mean, round(sd, 8) AS sd, round(sd / sqrt(n), 8) AS se, round(mean - 1.96e0 * sd / sqrt(n), 8) AS ci_low, round(mean + 1.96e0 * sd / sqrt(n), 8) AS ci_high FROM m""",
    ),
    "ld_decay_ci": (
        lambda s, d: r(summarize.confidence(ld.reaggregate(ld.decay(A.calls(s, d), A.spans(s, d)), ["rep", "pop", "distance_bin_bp"]), ["pop", "distance_bin_bp"], "mean_r2"), "mean", "sd", "se", "ci_low", "ci_high"),
        f"""WITH {CALLS}, {MAF}, {PAIRS.format(maf='0.1e0')}, g AS (SELECT rep, pop, distance_bin_bp, sum(sum_r2) / sum(n_pairs) AS v FROM decay GROUP BY ALL),
        m AS (SELECT pop, distance_bin_bp, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS n FROM g GROUP BY ALL)
        SELECT pop, distance_bin_bp, n, round(mean, 8) AS mean, round(sd, 8) AS sd, round(sd / sqrt(n), 8) AS se, round(mean - 1.96e0 * sd / sqrt(n), 8) AS ci_low, round(mean + 1.96e0 * sd / sqrt(n), 8) AS ci_high FROM m""",
    ),
    "hist_fixed_breaks": (
        lambda s, d: r(summarize.histogram(_stats(s, d), ["rep", "pop"], "sum_r2", 0.0, 0.01, 11), "xmin", "xmax", "xmid", "frac"),
        f"WITH {STATS}, {HIST.format(by='rep, pop', x='sum_r2', low='0e0', w='0.01e0', bins=11, src='st')} SELECT * FROM hist",
    ),
    "hist_data_range": (
        lambda s, d: r(summarize.histogram_over_range(A.kinship_pairs(s, d), ["rep", "pop"], "kinship", 0.01), "xmin", "xmax", "xmid", "frac"),
        f"""WITH {KIN}, ends AS (SELECT floor(min(kinship) / 0.01e0) AS lo, ceil(max(kinship) / 0.01e0) AS hi FROM kin),
        k AS (SELECT rep, pop, kinship FROM kin), {HIST.format(by='rep, pop', x='kinship', low='(SELECT lo * 0.01e0 FROM ends)', w='0.01e0', bins='(SELECT CAST(greatest(hi - lo, 1) AS INT) FROM ends)', src='k')} SELECT * FROM hist""",
    ),
    "hist_summary": (
        lambda s, d: r(summarize.mean_sd(summarize.histogram(_stats(s, d), ["rep", "pop"], "sum_r2", 0.0, 0.01, 11).withColumn("frac", F.round("frac", 8)), ["pop", "bin"], "frac", bands=2, floor=0.0), "mean", "sd", "low", "high", n=7),
        f"""WITH {STATS}, {HIST.format(by='rep, pop', x='sum_r2', low='0e0', w='0.01e0', bins=11, src='st')}, m AS (SELECT pop, bin, avg(frac) AS mean, stddev_samp(frac) AS sd, count(frac) AS n FROM hist GROUP BY ALL)
        SELECT pop, bin, n, round(mean, 7) AS mean, round(sd, 7) AS sd, round(CASE WHEN mean - 2 * sd < 0 THEN 0 ELSE mean - 2 * sd END, 7) AS low, round(mean + 2 * sd, 7) AS high FROM m""",
    ),
    "boxplot_stats": (
        lambda s, d: r(summarize.box(A.table(s, d, "customer"), ["c_mktsegment"], "c_acctbal"), "q1", "median", "q3", "low", "high", n=6),
        """WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY ALL)
        SELECT c_mktsegment, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(c_acctbal) FILTER (c_acctbal >= q1 - 1.5e0 * (q3 - q1)), 6) AS low, round(max(c_acctbal) FILTER (c_acctbal <= q3 + 1.5e0 * (q3 - q1)), 6) AS high
        FROM customer JOIN q USING (c_mktsegment) GROUP BY c_mktsegment, q1, median, q3""",
    ),
    "five_numbers": (
        lambda s, d: r(summarize.five_numbers(A.kinship_pairs(s, d), ["rep", "pop"], "kinship"), "min", "q1", "median", "mean", "q3", "max", n=6),
        f"""WITH {KIN} SELECT rep, pop, round(min(kinship), 6) AS min, round(quantile_cont(kinship, 0.25), 6) AS q1, round(quantile_cont(kinship, 0.5), 6) AS median, round(avg(kinship), 6) AS mean,
        round(quantile_cont(kinship, 0.75), 6) AS q3, round(max(kinship), 6) AS max FROM kin GROUP BY ALL""",
    ),
    "ecdf": (
        lambda s, d: r(summarize.ecdf(_stats(s, d), ["pop", "rep"], "value"), "share"),
        f"WITH {STATS} SELECT DISTINCT pop, rep, value, round(cume_dist() OVER (PARTITION BY pop, rep ORDER BY value), 8) AS share FROM st",
    ),
    "segsites_summary": (
        lambda s, d: r(summarize.mean_sd(_sites(s, d).groupBy("rep", "chrom", "pop").agg(F.sum("count").alias("sites")), ["chrom", "pop"], "sites", bands=2, floor=0.0), "mean", "sd", "low", "high"),
        f"""WITH {CALLS}, {COUNTS}, {SFS}, t AS (SELECT rep, chrom, pop, sum(count) AS sites FROM sfs WHERE derived_allele_count > 0 GROUP BY ALL), m AS (SELECT chrom, pop, avg(sites) AS mean, stddev_samp(sites) AS sd, count(sites) AS n FROM t GROUP BY ALL)
        SELECT chrom, pop, n, round(mean, 8) AS mean, round(sd, 8) AS sd, round(CASE WHEN mean - 2 * sd < 0 THEN 0 ELSE mean - 2 * sd END, 8) AS low, round(mean + 2 * sd, 8) AS high FROM m""",
    ),
    "share_within_group": (
        lambda s, d: r(summarize.share(_sites(s, d), "count", ["rep", "chrom", "pop"]), "frac"),
        f"WITH {CALLS}, {COUNTS}, {SFS} SELECT *, round(count / sum(count) OVER (PARTITION BY rep, chrom, pop), 8) AS frac FROM sfs WHERE derived_allele_count > 0",
    ),
    "share_truncated_pop": (
        lambda s, d: r(summarize.share(_stats(s, d).where("derived_allele_count > 0 AND derived_allele_count <= 15").groupBy("pop", "derived_allele_count").agg(F.sum("count").alias("count")), "count", ["pop"]), "frac"),
        f"WITH {STATS}, t AS (SELECT pop, derived_allele_count, sum(count) AS count FROM st WHERE derived_allele_count > 0 AND derived_allele_count <= 15 GROUP BY ALL) SELECT *, round(count / sum(count) OVER (PARTITION BY pop), 8) AS frac FROM t",
    ),
    "sfs2d_global_frac": (
        lambda s, d: summarize.share(sfs.add_up(_stats(s, d).where("derived_allele_count > 0 AND other_count > 0"), ["rep", "pop", "pop2", "derived_allele_count", "other_count"]), "count", [], "frac_global")
        .select(F.concat_ws(" vs. ", "pop", "pop2").alias("pair"), "rep", "derived_allele_count", "other_count", F.round("frac_global", 10).alias("frac_global"), F.round(F.log10("count"), 8).alias("log_count")),
        f"""WITH {STATS}, t AS (SELECT rep, pop, pop2, derived_allele_count, other_count, sum(count) AS count FROM st WHERE derived_allele_count > 0 AND other_count > 0 GROUP BY ALL)
        SELECT pop || ' vs. ' || pop2 AS pair, rep, derived_allele_count, other_count, round(count / sum(count) OVER (), 10) AS frac_global, round(log10(count), 8) AS log_count FROM t""",
    ),
    "count_by_pop": (lambda s, d: A.fam(s, d).groupBy("pop").count(), f"WITH {FAM} SELECT pop, count(*) AS count FROM fam GROUP BY pop"),
    "admix_order_boundaries": (
        lambda s, d: summarize.ordered_boundaries(A.fam(s, d), X.level("pop", A.POPS)),
        f"""WITH {FAM}, t AS (SELECT list_position(['AFR', 'EUR', 'ADX'], pop) AS grp, count(*) AS n FROM fam GROUP BY ALL), c AS (SELECT grp, n, CAST(sum(n) OVER (ORDER BY grp) AS BIGINT) AS xmax FROM t)
        SELECT grp, n, lag(xmax, 1, 0) OVER (ORDER BY grp) + 1 AS xmin, xmax, (lag(xmax, 1, 0) OVER (ORDER BY grp) + 1 + xmax) / 2e0 AS xmid FROM c""",
    ),
    "admix_sample_order": (
        lambda s, d: summarize.ordered(A.fam(s, d).join(A.q(s, d), "row_idx"), X.level("pop", A.POPS), "afr_q", "iid").select("pop", "iid", F.round("afr_q", 8).alias("afr_q"), "ind"),
        f"""WITH {FAM} SELECT pop, iid, round(afr_q, 8) AS afr_q, row_number() OVER (ORDER BY list_position(['AFR', 'EUR', 'ADX'], pop), afr_q DESC, iid) AS ind FROM fam JOIN q USING (row_idx)""",
    ),
    "admix_separators": (
        lambda s, d: summarize.separators(summarize.ordered_boundaries(A.fam(s, d), X.level("pop", A.POPS))),
        f"""WITH {FAM}, t AS (SELECT list_position(['AFR', 'EUR', 'ADX'], pop) AS grp, count(*) AS n FROM fam GROUP BY ALL), c AS (SELECT grp, CAST(sum(n) OVER (ORDER BY grp) AS BIGINT) AS xmax, row_number() OVER (ORDER BY grp DESC) AS back FROM t)
        SELECT grp, xmax + 0.5e0 AS at FROM c WHERE back > 1""",
    ),
    "spectrum_summary": (
        lambda s, d: r(summarize.spectrum_summary(_sites(s, d), ["chrom", "pop"], "derived_allele_count"), "mean_frac", "sd_frac", "mean_count", "sd_count"),
        f"""WITH {CALLS}, {COUNTS}, {SFS}, t AS (SELECT *, count / sum(count) OVER (PARTITION BY rep, chrom, pop) AS frac FROM sfs WHERE derived_allele_count > 0)
        SELECT chrom, pop, derived_allele_count, round(avg(frac), 8) AS mean_frac, round(stddev_samp(frac), 8) AS sd_frac, round(avg(count), 8) AS mean_count, round(stddev_samp(count), 8) AS sd_count FROM t GROUP BY ALL""",
    ),
    "unpivot_q": (lambda s, d: r(_q_long(s, d), "share"), f"WITH {FAM}, j AS (SELECT row_idx, pop, afr_q, eur_q FROM fam JOIN q USING (row_idx)) SELECT row_idx, pop, source, round(share, 8) AS share FROM (SELECT row_idx, pop, 'afr_q' AS source, afr_q AS share FROM j UNION ALL SELECT row_idx, pop, 'eur_q', eur_q FROM j)"),
    "bind_rows_all": (
        lambda s, d: r(summarize.bind([ld.reaggregate(_stats(s, d), ["rep", "chrom", "pop"]), ld.reaggregate(_stats(s, d), ["rep", "pop"]).withColumn("source", F.lit("genome"))]).withColumn("chrom", F.coalesce("chrom", F.lit("all"))), "sum_r2", "mean_r2", n=6),
        f"""WITH {STATS} SELECT rep, chrom, pop, round(sum(sum_r2), 6) AS sum_r2, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, round(sum(sum_r2) / sum(n_pairs), 6) AS mean_r2, NULL AS source FROM st GROUP BY rep, chrom, pop
        UNION ALL SELECT rep, 'all', pop, round(sum(sum_r2), 6), CAST(sum(n_pairs) AS BIGINT), round(sum(sum_r2) / sum(n_pairs), 6), 'genome' FROM st GROUP BY rep, pop""",
    ),
    "chrom_level_order": (
        lambda s, d: _stats(s, d).groupBy("chrom").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).withColumn("place", X.level("chrom", CHROM_LEVELS)),
        f"WITH {STATS} SELECT chrom, count(*) AS n, min(value) AS least, max(value) AS most, CAST(chrom AS INT) AS place FROM st GROUP BY chrom",
    ),
    "combine_missing_check": (
        lambda s, d: tables.require_units(_stats(s, d), _stats(s, d).select("rep").distinct().crossJoin(F.broadcast(s.range(1, 4).select(F.col("id").cast("string").alias("chrom")))), ["rep", "chrom"]).groupBy("rep", "chrom").agg(F.count("*").alias("n")),
        f"WITH {STATS} SELECT rep, chrom, count(*) AS n FROM st GROUP BY ALL",
    ),
    "task_grid": (
        lambda s, d: tables.task_grid(A.table(s, d, "orders").select((F.col("o_orderkey") % 1100 + 1).alias("task")).groupBy("task").agg(F.count("*").alias("n")), "task", 50, CHROM_LEVELS),
        "SELECT task, n, CAST((task - 1) % 50 + 1 AS INT) AS rep, CAST((task - 1) // 50 + 1 AS VARCHAR) AS chrom FROM (SELECT o_orderkey % 1100 + 1 AS task, count(*) AS n FROM orders GROUP BY ALL)",
    ),
    "interval_overlap": (
        lambda s, d: r(_overlaps(s, d).select("w", "p", "overlap", "weight"), "weight"),
        f"WITH {PERIODS} SELECT w, p, least(w_end, p_end) - greatest(w_start, p_start) AS overlap, round((least(w_end, p_end) - greatest(w_start, p_start)) / (p_end - p_start), 8) AS weight FROM w JOIN p ON w_start < p_end AND p_start < w_end",
    ),
    "interval_history": (
        lambda s, d: r(intervals.window_totals(_windows(s, d), _periods(s, d), "value_start", 64.0).select("w", "total", "first", "last", "observed"), "total", n=5),
        f"""WITH {PERIODS}, o AS (SELECT *, least(w_end, p_end) - greatest(w_start, p_start) AS overlap FROM w JOIN p ON w_start < p_end AND p_start < w_end)
        SELECT w, round(sum(value_start * (overlap / (p_end - p_start))), 5) AS total, min(p_start) AS first, max(p_end) AS last, sum(overlap) AS observed FROM o GROUP BY w""",
    ),
    "boundary_value": (
        lambda s, d: r(intervals.at_point(_windows(s, d).select("w", F.col("w_start").alias("at")), _periods(s, d).groupBy("p_start").agg(F.max("p_end").alias("p_end"), F.min("value_start").alias("value_start"), F.max("value_end").alias("value_end")), "at", 16.0), "value", n=6),
        f"""WITH {PERIODS}, one AS (SELECT p_start, max(p_end) AS p_end, min(value_start) AS a, max(value_end) AS b FROM p GROUP BY p_start),
        hit AS (SELECT w, w_start AS at, arg_max(a + (b - a) * ((w_start - p_start) / (p_end - p_start)), p_start) AS value FROM w JOIN one ON p_start <= w_start AND w_start <= p_end GROUP BY ALL)
        SELECT w.w, w.w_start AS at, round(value, 6) AS value FROM w LEFT JOIN hit USING (w)""",
    ),
    "lagged_births": (
        lambda s, d: r(ne_by_segment(s, d), "births", "prev_births", "ne", n=5),
        """WITH b AS (SELECT c_mktsegment, CAST(o_custkey % 15 AS INT) AS generation, sum(round(o_totalprice)) AS births FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        l AS (SELECT *, lag(births) OVER (PARTITION BY c_mktsegment ORDER BY generation) AS prev_births FROM b)
        SELECT c_mktsegment, generation, round(births, 5) AS births, round(prev_births, 5) AS prev_births, round(4 * floor(births / 3) * (0.5e0 * prev_births) / nullif(floor(births / 3) + 0.5e0 * prev_births, 0), 5) AS ne FROM l""",
    ),
    "piecewise_size": (
        lambda s, d: r(ne_model.piecewise(A.table(s, d, "lineitem").select(F.expr("CAST(1625 + l_orderkey % 376 AS INT)").alias("year")).groupBy("year").agg(F.count("*").alias("n")), [(8.0, 40000.0, 0.05), (15.0, 20000.0, 0.0)]), "ne", n=5),
        """WITH y AS (SELECT CAST(1625 + l_orderkey % 376 AS INT) AS year, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT year, n, round(CASE WHEN (2000 - year) / 25e0 <= 8 THEN 40000 * exp(-0.05e0 * ((2000 - year) / 25e0)) WHEN (2000 - year) / 25e0 <= 15 THEN 20000e0 END, 5) AS ne FROM y""",
    ),
    "kde_grid": (
        lambda s, d: r(summarize.density(A.kinship_pairs(s, d), ["rep", "pop"], "kinship", -0.05, 0.10, 60), "x", "density", n=6),
        f"""WITH {KIN}, b AS (SELECT rep, pop, stddev_samp(kinship) AS sd, quantile_cont(kinship, 0.75) - quantile_cont(kinship, 0.25) AS iqr, count(*) AS n FROM kin GROUP BY ALL),
        bw AS (SELECT rep, pop, n, 0.9e0 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34e0) ELSE sd END * pow(n, -0.2e0) AS bw FROM b),
        points AS (SELECT k.*, bw.n, bw.bw, unnest(generate_series(0, 59)) AS k FROM kin k JOIN bw USING (rep, pop) WHERE bw > 0)
        SELECT rep, pop, CAST(k AS INT) AS k, round(-0.05e0 + k * (0.15e0 / 59), 6) AS x, round(sum(exp(-0.5e0 * pow((-0.05e0 + k * (0.15e0 / 59) - kinship) / bw, 2)) / (n * bw * 2.5066282746310002e0)), 6) AS density FROM points GROUP BY rep, pop, k""",
    ),
    "kde_summary": (
        lambda s, d: r(summarize.density_summary(summarize.density(A.kinship_pairs(s, d), ["rep", "pop"], "kinship", -0.05, 0.10, 500), ["pop"]), "x", "mean", "sd", "low", "high", n=5),
        f"""WITH {KIN}, {KDE.format(last=499)}, each AS (SELECT rep, pop, CAST(k AS INT) AS k, sum(exp(-0.5e0 * pow((-0.05e0 + k * (0.15e0 / 499) - kinship) / bw, 2)) / (n * bw * 2.5066282746310002e0)) AS density FROM points GROUP BY rep, pop, k),
        m AS (SELECT pop, k, avg(density) AS mean, stddev_samp(density) AS sd FROM each GROUP BY ALL)
        SELECT pop, k, round(-0.05e0 + k * (0.15e0 / 499), 5) AS x, round(mean, 5) AS mean, round(sd, 5) AS sd, round(CASE WHEN mean - sd < 0 THEN 0 ELSE mean - sd END, 5) AS low, round(mean + sd, 5) AS high FROM m""",
    ),
    "kinship_means": (
        lambda s, d: r(kinship.individual_means(A.kinship_pairs(s, d), ["rep", "pop"]), "mean_kinship", n=12),
        f"WITH {KIN} SELECT rep, pop, sample, round(avg(kinship), 12) AS mean_kinship FROM (SELECT rep, pop, sample1 AS sample, kinship FROM kin UNION ALL SELECT rep, pop, sample2, kinship FROM kin) GROUP BY ALL",
    ),
}


def ne_by_segment(s, d):
    """Size from lagged births by generation, within each market segment."""
    from pyspark.sql import Window as W

    births = A.table(s, d, "orders").join(A.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = births.groupBy("c_mktsegment", (F.col("o_custkey") % 15).cast("int").alias("generation")).agg(F.sum(F.round("o_totalprice")).alias("births"))
    lagged = rows.withColumn("prev_births", F.lag("births").over(W.partitionBy("c_mktsegment").orderBy("generation")))
    return lagged.withColumn("ne", X.ne_from_sexes(F.floor(F.col("births") / 3), F.col("prev_births") * 0.5))
