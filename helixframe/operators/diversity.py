"""Nucleotide diversity and Watterson's theta, by chromosome and for the genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import divide, finite, harmonic, ne_from_diversity
from .genotype import UNIT

MUTATION_RATE = 2.36e-8


def pi_theta(calls: DataFrame, spans: DataFrame, mutation_rate: float = MUTATION_RATE) -> DataFrame:
    """Span-normalised pi and theta of each population, one row for each statistic.

    Sites are first reduced to sums over their alleles, so a chromosome needs one pass of partial sums.
    """
    by_allele = calls.groupBy(*UNIT, "pop", "site_id", "allele").agg(F.count("*").alias("x"))
    by_site = by_allele.groupBy(*UNIT, "pop", "site_id").agg(F.sum("x").alias("n"), F.sum(F.col("x") * (F.col("x") - 1)).alias("same"), F.count("*").alias("alleles"))
    differ = F.lit(1.0) - divide(F.col("same").cast("double"), F.col("n") * (F.col("n") - 1))
    sums = by_site.groupBy(*UNIT, "pop").agg(F.sum(differ).alias("pi_sum"), F.sum(F.col("alleles") - 1).cast("double").alias("s_sum"), F.max("n").alias("n"))
    full = sums.join(spans, UNIT).withColumn("a_n", harmonic("n")).withColumn("s", F.col("s_sum") / F.col("span"))
    stat = F.inline(
        F.array(
            F.struct(F.lit("pi").alias("stat"), (F.col("pi_sum") / F.col("span")).alias("value"), F.lit(None).cast("double").alias("segregating_sites")),
            F.struct(F.lit("theta").alias("stat"), (F.col("s") / F.col("a_n")).alias("value"), F.col("s").alias("segregating_sites")),
        )
    )
    rows = full.select(*UNIT, "pop", "span", F.col("a_n").alias("wattersons_const"), stat)
    return rows.select(*UNIT, "pop", "stat", "value", ne_from_diversity("value", mutation_rate).alias("ne_value"), F.lit(mutation_rate).alias("mutation_rate"), "span", "segregating_sites", "wattersons_const")


def genome_pi_theta(rows: DataFrame, haplotypes: DataFrame, corrected: bool = True) -> DataFrame:
    """Genome statistics of each replicate from chromosome rows and haplotype counts (pop, haplotypes).

    pi is the span-weighted mean, times h / (h - 1) if ``corrected``; theta is the span-weighted
    density of segregating sites over the first chromosome's constant.
    """
    known = F.col("stat").isin("pi", "theta")
    checked = rows.withColumn("stat", F.when(known, F.col("stat")).otherwise(F.raise_error(F.concat(F.lit("unknown statistic "), F.col("stat")))))
    first = lambda x: F.min_by(x, F.struct(F.length("chrom"), F.col("chrom")))
    sums = checked.groupBy("rep", "pop", "stat").agg(
        divide(F.sum(F.col("value") * F.col("span")), F.sum("span")).alias("mean"),
        divide(F.sum(finite("segregating_sites") * F.col("span")), F.sum("span")).alias("s"),
        first("mutation_rate").alias("mutation_rate"),
        first("wattersons_const").alias("a_n"),
    )
    full = sums.join(haplotypes, "pop", "left")
    h = F.when(F.col("haplotypes") >= 2, F.col("haplotypes")).otherwise(F.raise_error(F.concat(F.lit("too few haplotypes for "), F.col("pop"))))
    pi = F.col("mean") * h / (h - 1) if corrected else F.col("mean")
    value = F.when(F.col("stat") == "pi", pi).otherwise(F.col("s") / F.col("a_n"))
    theta = F.col("stat") == "theta"
    return full.withColumn("value", value).select(
        "rep", "pop", "stat", "value", (F.col("value") / (F.lit(4) * F.col("mutation_rate"))).alias("ne_value"), "mutation_rate",
        F.when(theta, F.col("s")).alias("segregating_sites"), F.when(theta, F.col("a_n")).alias("wattersons_const"),
    )


def haplotypes_by_pop(fam: DataFrame) -> DataFrame:
    """Two haplotypes for each sample row."""
    return fam.groupBy("pop").agg((F.count("*") * 2).alias("haplotypes"))
