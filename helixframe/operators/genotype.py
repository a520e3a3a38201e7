"""Genotype tables: allele counts, frequency filters, dosages, duplicate removal and sample lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import folded

UNIT = ["rep", "chrom"]
SITE = [*UNIT, "site_id", "position"]


def allele_counts(calls: DataFrame, by: list[str] = ["pop"]) -> DataFrame:
    """Per site (and group): copies of each derived allele kept as n_alt (allele 1), all calls and non-reference calls."""
    return calls.groupBy(*SITE, *by).agg(
        F.count(F.when(F.col("allele") >= 0, 1)).alias("n_called"),
        F.count(F.when(F.col("allele") == 1, 1)).alias("n_alt"),
        F.count(F.when(F.col("allele") > 0, 1)).alias("n_derived"),
    )


def pooled_maf(calls: DataFrame) -> DataFrame:
    """Minor-allele frequency of each site over all populations together, from allele 1 only."""
    counts = allele_counts(calls, [])
    return counts.select(*SITE, folded(F.col("n_alt") / F.col("n_called")).alias("maf"))


def maf_filter(calls: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Calls at sites whose pooled minor-allele frequency reaches the threshold."""
    kept = pooled_maf(calls).where(F.col("maf") >= threshold).select(*UNIT, "site_id")
    return calls.join(kept, [*UNIT, "site_id"], "left_semi")


def dosages(calls: DataFrame) -> DataFrame:
    """Non-reference allele count of each individual at each site."""
    return calls.groupBy(*SITE, "pop", "ind").agg(F.sum((F.col("allele") > 0).cast("int")).cast("int").alias("dosage"))


def drop_duplicate_positions(variants: DataFrame, order: str = "file_order") -> DataFrame:
    """The first record at each position of a chromosome."""
    rank = F.row_number().over(W.partitionBy("chrom", "position").orderBy(order))
    return variants.withColumn("_n", rank).where("_n = 1").drop("_n")


def biallelic_snps(variants: DataFrame) -> DataFrame:
    """Records with one alternate, both alleles one base."""
    one = ~F.col("alt").contains(",") & (F.length("alt") == 1) & (F.length("ref") == 1)
    return variants.where(one & F.col("alt").rlike("^[ACGTN]$") & F.col("ref").rlike("^[ACGTN]$"))


def keep(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Sample keep-lists and variant extract-lists."""
    return rows.join(wanted.select(*on).distinct(), on, "left_semi")


def pop_prefix(iid: Column | str) -> Column:
    """Population of a sample id: what is before its first underscore."""
    return F.split(iid, "_", 2)[0]
