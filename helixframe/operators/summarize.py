"""Across-replicate summaries: moments, bands, histograms, shares, densities and quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import c, clamp_low, finite, histogram_index
from ..sources.checkpoints import cut

#: Edges of the bins in which values are ranked.
EDGES = 63
#: Rows of a group of which one task may hold the counted values; the quantiles of larger ones are found by ranks in bins.
GROUP_ROWS = 1_000_000


def small_groups(rows: DataFrame, by: Sequence[str]) -> bool:
    """Whether no group has over GROUP_ROWS rows, from their counts alone."""
    return (rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= GROUP_ROWS


def mean_sd(rows: DataFrame, by: Sequence[str], value: str, with_median: bool = False, bands: float | None = None, floor: float | None = None) -> DataFrame:
    """Mean and sample deviation (null for one row), optionally the median and mean +- ``bands`` deviations."""
    x = finite(value)
    aggregates = [F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n")]
    whole = with_median and small_groups(rows, by)
    out = rows.groupBy(*by).agg(*aggregates, *([F.median(x).alias("median")] if whole else []))
    if with_median and not whole:
        middle = ranked_quantiles(ranked(rows, by, value), by, value, {"median": 0.5}).withColumnsRenamed({c: f"_{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        out = out.join(middle, same, "left").drop(*[f"_{c}" for c in by])
    if bands is not None:
        low = F.col("mean") - bands * F.col("sd")
        out = out.withColumn("low", low if floor is None else clamp_low(low, floor)).withColumn("high", F.col("mean") + bands * F.col("sd"))
    return out


def ranked(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, n, before, total): each distinct finite value, how often it occurs, how many rows are smaller, and all rows.

    Values are counted, dealt into up to EDGES + 1 bins between approximate quantiles of the distinct values, and ranked inside
    their bin, so no task holds a group; the bins' counts place them after each other. Ranks are exact, whatever the edges.
    """
    value_of = c(value)
    counts = rows.where(finite(value).isNotNull()).groupBy(*by, value_of.alias("_v")).agg(F.count("*").alias("n"))
    probabilities = [i / (EDGES + 1) for i in range(1, EDGES + 1)]
    edges = counts.groupBy(*by).agg(F.percentile_approx("_v", probabilities, 1000).alias("_edges"))
    # One exchange by bin serves the ranks inside and the bins' counts.
    binned = counts.join(edges, list(by)).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges").repartition(*by, "_bin")
    inside = W.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    within = binned.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    group = W.partitionBy(*by)  # one row for each bin
    bins = binned.groupBy(*by, "_bin").agg(F.sum("n").alias("_n"))
    starts = bins.select(*by, "_bin", F.coalesce(F.sum("_n").over(group.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(group).alias("total"))
    return within.join(starts, [*by, "_bin"]).select(*by, F.col("_v").alias(value), "n", (F.col("_start") + F.col("_inside")).alias("before"), "total")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, at: dict[str, float], *others: Column) -> DataFrame:
    """Exact quantiles of each group's finite values by name, interpolated between neighbouring ranks, and other aggregates of the rows.

    A group's values are counted in one partial aggregation; where a group is too large for that, its values are ranked in bins.
    """
    fine = rows.where(finite(value).isNotNull())
    if small_groups(fine, by):
        found = fine.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in at.values()])).alias("_q"), *others)
        return found.select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(at)], *[x for x in found.columns if x not in by and x != "_q"])
    ranks = ranked_quantiles(ranked(rows, by, value), by, value, at)
    return ranks.join(fine.groupBy(*by).agg(*others), list(by)) if others else ranks


def ranked_quantiles(places: DataFrame, by: Sequence[str], value: str, at: dict[str, float], *others: Column) -> DataFrame:
    """Exact quantiles of ``ranked`` rows by name, interpolated between neighbouring ranks, and other aggregates of those rows."""
    held = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))
    parts, out = [], []
    for name, p in at.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        parts += [held(F.floor(h)).alias(f"_{name}_low"), held(F.ceil(h)).alias(f"_{name}_high"), F.max(h - F.floor(h)).alias(f"_{name}_part")]
        out.append((F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * F.col(f"_{name}_part")).alias(name))
    rows = places.groupBy(*by).agg(*parts, *others)
    return rows.select(*by, *out, *[x for x in rows.columns if x not in by and not x.startswith("_")])


def median_of_means(rows: DataFrame, within: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """Exact medians over ``by`` of each inner group's mean and deviation."""
    inner = mean_sd(rows, [*within], value).unpivot(list(by), ["mean", "sd"], "_what", "_x")
    middle = quantiles(inner, [*by, "_what"], "_x", {"median": 0.5})  # both in one pass
    of = lambda x: F.max(F.when(F.col("_what") == x, F.col("median"))).alias(f"median_{x}")
    return middle.groupBy(*by).agg(of("mean"), of("sd"))


def confidence(rows: DataFrame, by: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    """Mean, deviation, standard error and normal interval across replicates."""
    out = mean_sd(rows, by, value).withColumn("se", F.col("sd") / F.sqrt(F.col("n")))
    return out.withColumn("ci_low", F.col("mean") - z * F.col("se")).withColumn("ci_high", F.col("mean") + z * F.col("se"))


def share(rows: DataFrame, value: str, within: Sequence[str], name: str = "frac") -> DataFrame:
    """Each row's part of its group's sum; the sums are aggregated first, so a large group is no single task."""
    if not within:
        return rows.crossJoin(F.broadcast(rows.agg(F.sum(value).alias("_sum")))).withColumn(name, c(value) / F.col("_sum")).drop("_sum")
    sums = rows.groupBy(*within).agg(F.sum(value).alias("_sum"))
    return rows.join(sums, list(within)).withColumn(name, c(value) / F.col("_sum")).drop("_sum")


def histogram(rows: DataFrame, by: Sequence[str], value: str, low: float, width: float, bins: int) -> DataFrame:
    """Right-closed bins with fixed edges, empty ones kept, and each bin's share of its group."""
    placed = rows.where(finite(value).isNotNull()).withColumn("bin", histogram_index(value, low, width))
    counts = placed.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    # A group's counts are few: one row holds them all and is spread over all bins.
    held = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    full = held.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))).withColumn("count", F.coalesce(F.element_at("held", F.col("bin")), F.lit(0).cast("long")))
    edge = lambda i: F.round(F.lit(low) + i * F.lit(width), 10)
    return full.select(*by, "bin", edge(F.col("bin") - 1).alias("xmin"), edge(F.col("bin")).alias("xmax"), edge(F.col("bin") - 0.5).alias("xmid"), "count", (F.col("count") / F.col("total")).alias("frac"))


def histogram_over_range(rows: DataFrame, by: Sequence[str], value: str, width: float) -> DataFrame:
    """A histogram whose edges are the multiples of ``width`` around the whole column's range."""
    ends = rows.agg(F.floor(F.min(value) / width).alias("lo"), F.ceil(F.max(value) / width).alias("hi")).first()
    if ends is None or ends["lo"] is None:
        return histogram(rows, by, value, 0.0, width, 1)
    return histogram(rows, by, value, ends["lo"] * width, width, max(int(ends["hi"] - ends["lo"]), 1))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact quartiles and the whiskers: the outermost values within 1.5 interquartile ranges."""
    joined = rows.where(finite(value).isNotNull()).join(quantiles(rows, by, value, QUARTILES), list(by))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    x = c(value)
    return joined.groupBy(*by, *QUARTILES).agg(F.min(F.when(x >= F.col("q1") - reach, x)).alias("low"), F.max(F.when(x <= F.col("q3") + reach, x)).alias("high"))


def five_numbers(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Least, quartiles, mean and largest of each group's finite values."""
    return quantiles(rows, by, value, QUARTILES, F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(*by, "min", "q1", "median", "mean", "q3", "max")


def ecdf(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The share of a group's finite values that are no larger, for each distinct value."""
    return ranked(rows, by, value).select(*by, value, ((F.col("before") + F.col("n")) / F.col("total")).alias("share"))


def density(rows: DataFrame, by: Sequence[str], value: str, low: float, high: float, points: int = 500) -> DataFrame:
    """Gaussian kernel density on a shared grid, with the rule-of-thumb bandwidth of each group.

    Equal values are counted first, so the grid meets distinct values, not rows.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("w"))
    width = quantiles(rows, by, value, {"q1": 0.25, "q3": 0.75}).select(*by, (F.col("q3") - F.col("q1")).alias("iqr"))
    spread = rows.groupBy(*by).agg(F.stddev_samp(value).alias("sd"), F.count("*").alias("n")).join(width, list(by), "left")
    narrow = F.when(F.col("iqr") > 0, F.least(F.col("sd"), F.col("iqr") / 1.34)).otherwise(F.col("sd"))
    bandwidth = spread.select(*by, "n", (F.lit(0.9) * narrow * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))
    step = (high - low) / (points - 1)
    at = counts.join(bandwidth, list(by)).where("bw > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.lit(low) + F.col("k") * F.lit(step)
    u = (x - c(value)) / F.col("bw")
    kernel = F.col("w") * F.exp(-0.5 * u * u) / (F.col("n") * F.col("bw") * F.lit(2.5066282746310002))
    return at.groupBy(*by, "k").agg(F.sum(kernel).alias("density")).select(*by, "k", (F.lit(low) + F.col("k") * F.lit(step)).alias("x"), "density")


def density_summary(densities: DataFrame, by: Sequence[str], floor: float = 0.0) -> DataFrame:
    """Mean and deviation across replicates at each grid point, and the band of one deviation, not below ``floor``."""
    out = densities.groupBy(*by, "k", "x").agg(F.avg("density").alias("mean"), F.stddev_samp("density").alias("sd"))
    return out.withColumn("low", clamp_low(F.col("mean") - F.col("sd"), floor)).withColumn("high", F.col("mean") + F.col("sd"))


def spectrum_summary(spectra: DataFrame, by: Sequence[str], bin: str, within: str = "rep") -> DataFrame:
    """Mean and deviation across replicates of each bin's share of its spectrum and of its count."""
    shares = share(spectra, "count", [within, *by])
    return shares.groupBy(*by, bin).agg(F.avg("frac").alias("mean_frac"), F.stddev_samp("frac").alias("sd_frac"), F.avg("count").alias("mean_count"), F.stddev_samp("count").alias("sd_count"))


def ordered(rows: DataFrame, group: Column, value: str, tie: str) -> DataFrame:
    """Each row's 1-based place ``ind`` on a global axis sorted by (group, value descending, tie).

    Rows are sorted by range and numbered inside each range; the ranges' sizes, one number each, place them after each other.
    Equal (group, value, tie) rows may swap places.
    """
    keys = [F.col("_group").asc(), F.col(value).desc(), F.col(tie).asc()]
    placed = cut(rows.withColumn("_group", group).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    numbered = placed.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*keys)))
    sizes = placed.groupBy(F.col("_part").alias("_range")).count()
    starts = sizes.withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")  # one row for each range
    return numbered.join(starts, F.col("_part") == F.col("_range")).withColumn("ind", F.col("_before") + F.col("_n")).drop("_group", "_part", "_n", "_range", "_before")


def ordered_boundaries(rows: DataFrame, group: Column) -> DataFrame:
    """First, last and middle place of each group on the axis of ``ordered``; only counts are needed."""
    counts = rows.groupBy(group.alias("grp")).agg(F.count("*").alias("n"))
    before = W.orderBy("grp").rowsBetween(W.unboundedPreceding, 0)  # one row for each group
    ends = counts.withColumn("xmax", F.sum("n").over(before))
    starts = ends.withColumn("xmin", F.lag("xmax", 1, 0).over(W.orderBy("grp")) + 1)
    return starts.select("grp", "n", "xmin", "xmax", ((F.col("xmin") + F.col("xmax")) / 2).alias("xmid"))


def separators(boundaries: DataFrame) -> DataFrame:
    """Where lines between groups stand: after each group but the last."""
    last = F.max("grp").over(W.partitionBy())  # one row for each group
    return boundaries.withColumn("_last", last).where("grp < _last").select("grp", (F.col("xmax") + 0.5).alias("at"))


def bind(tables: Sequence[DataFrame]) -> DataFrame:
    """Row-bind with the union of the columns; missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
