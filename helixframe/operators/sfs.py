"""One- and two-dimensional site-frequency spectra and their aggregation over chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import cut
from .genotype import UNIT

#: Cells of dense spectra that one task makes, and tasks at most.
TASK_CELLS, TASKS = 2_000_000, 4_000


def derived_counts(calls: DataFrame) -> DataFrame:
    """(rep, chrom, site_id, allele, pops, counts): for each derived allele its copies by population that carries it, and the
    chromosome's populations.

    Calls are reduced to one number for each site, allele and population in one pass; everything else reads those.
    """
    carried = calls.groupBy(*UNIT, "site_id", "allele", "pop").count()
    pops = carried.groupBy(*UNIT).agg(F.sort_array(F.collect_set("pop")).alias("pops"))
    counts = F.map_from_entries(F.collect_list(F.struct("pop", "count"))).alias("counts")
    return carried.where("allele > 0").groupBy(*UNIT, "site_id", "allele").agg(counts).join(pops, UNIT)


def _copies(pop) -> F.Column:
    return F.coalesce(F.element_at("counts", pop), F.lit(0).cast("long")).cast("int")


def sfs_1d(calls: DataFrame) -> DataFrame:
    """Occupied bins of the polarised spectrum of each population."""
    counts = derived_counts(calls).select(*UNIT, "counts", F.explode("pops").alias("pop"))
    return counts.groupBy(*UNIT, "pop", _copies(F.col("pop")).alias("derived_allele_count")).agg(F.count("*").cast("double").alias("count"))


def sfs_dense(calls: DataFrame) -> DataFrame:
    """All bins from 0 to the number of haploids, empty ones with 0."""
    pops = calls.groupBy(*UNIT, "pop").agg(F.count_distinct("ind", "hap").cast("int").alias("n"))
    grid = pops.select(*UNIT, "pop", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("derived_allele_count"))
    return grid.join(sfs_1d(calls), [*UNIT, "pop", "derived_allele_count"], "left").fillna(0.0, ["count"])


def sfs_2d(calls: DataFrame, pops: list[str]) -> DataFrame:
    """Occupied cells of the joint spectrum of each pair of populations, in list order."""
    couples = F.array(*[F.struct(F.lit(a).alias("pop1"), F.lit(b).alias("pop2")) for i, a in enumerate(pops) for b in pops[i + 1 :]])
    present = F.filter(couples, lambda c: F.array_contains("pops", c["pop1"]) & F.array_contains("pops", c["pop2"]))
    pairs = derived_counts(calls).select(*UNIT, "counts", F.explode(present).alias("c")).select(*UNIT, "c.pop1", "c.pop2", "counts")
    cells = pairs.select(*UNIT, "pop1", "pop2", _copies(F.col("pop1")).alias("pop1_count"), _copies(F.col("pop2")).alias("pop2_count"))
    return cells.groupBy(*UNIT, "pop1", "pop2", "pop1_count", "pop2_count").agg(F.count("*").cast("double").alias("count"))


def sfs_2d_dense(calls: DataFrame, pops: list[str], by: list[str] = UNIT) -> DataFrame:
    """All cells of each joint spectrum, empty ones with 0: for export, as the sparse form is far smaller. ``by`` without chrom adds
    chromosomes up.

    Empty cells are made last, row by row of the grids, so none is joined, added up or shuffled.
    """
    row = [*by, "pop1", "pop2", "pop1_count"]
    found = cut(sfs_2d(calls, pops) if by == UNIT else add_up(sfs_2d(calls, pops), [*row, "pop2_count"]))
    sizes = calls.groupBy(*UNIT, "pop").agg(F.count_distinct("ind", "hap").cast("int").alias("n"))
    side = lambda k: sizes.select(*UNIT, F.col("pop").alias(f"pop{k}"), F.array_position(F.array(*[F.lit(p) for p in pops]), F.col("pop")).alias(f"place{k}"), F.col("n").alias(f"n{k}"))
    couples = cut(side(1).join(side(2), UNIT).where("place1 > 0 AND place1 < place2"))
    cells = couples.agg(F.sum((F.col("n1") + 1).cast("long") * (F.col("n2") + 1))).first()[0] or 0
    rows = couples.select(*by, "pop1", "pop2", "n2", F.explode(F.sequence(F.lit(0), F.col("n1"))).alias("pop1_count")).groupBy(*row).agg(F.max("n2").alias("n2"))
    held = rows.join(found.groupBy(*row).agg(F.collect_list("pop2_count").alias("used")), row, "left").repartition(min(1 + cells // TASK_CELLS, TASKS), *row)
    empty = F.array_except(F.sequence(F.lit(0), F.col("n2")), F.coalesce("used", F.array().cast("array<int>")))
    return found.unionByName(held.select(*row, F.explode(empty).alias("pop2_count"), F.lit(0.0).alias("count")))


def add_up(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """Genome spectra: chromosome counts summed, in one or two dimensions."""
    return spectra.groupBy(*keys).agg(F.sum("count").alias("count"))
