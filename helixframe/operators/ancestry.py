"""Global and local ancestry from segments, admixture proportions and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import divide, labelled

# The two label tables differ for source population 2.
GLOBAL_NAMES = {0: "AFR", 1: "EUR"}
LOCAL_NAMES = {0: "AFR", 1: "EUR", 2: "ADX"}


def with_ids(rows: DataFrame, ind: str = "ind", pop: str = "pop", by: tuple[str, ...] = ()) -> DataFrame:
    """``sample_id`` counts individuals overall, ``vcf_sample_id`` from the first one present of the population (in each of ``by``)."""
    first = rows.groupBy(*by, pop).agg(F.min(ind).alias("_first"))
    joined = rows.join(first, [*by, pop])
    number = lambda n: F.concat_ws("_", F.col(pop), n.cast("string"))
    return joined.withColumn("sample_id", number(F.col(ind) + 1)).withColumn("vcf_sample_id", number(F.col(ind) - F.col("_first") + 1)).drop("_first")


def global_ancestry(segments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of each individual's length from AFR and EUR sources (in each of ``by``); other sources are left out.

    ``segments`` has pop, ind, left, right and population; both columns always exist.
    """
    named = segments.withColumn("name", labelled("population", GLOBAL_NAMES)).withColumn("length", F.col("right") - F.col("left"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("length"))), F.lit(0.0)).alias(name)
    spans = named.groupBy(*by, "pop", "ind").agg(of("AFR"), of("EUR"))
    out = with_ids(spans.withColumn("span", F.col("AFR") + F.col("EUR")), by=by)
    return out.select(*by, "pop", "sample_id", "vcf_sample_id", divide("AFR", "span").alias("afr_prop"), divide("EUR", "span").alias("eur_prop"), "span")


def local_ancestry(segments: DataFrame, chrom: str) -> DataFrame:
    """Segments with the individual's ids, the haplotype's number and the source's name."""
    hap = F.dense_rank().over(W.partitionBy("pop", "ind").orderBy("node"))
    out = with_ids(segments.withColumn("hap", hap))
    return out.select(F.concat(F.lit("chr"), F.lit(chrom)).alias("chrom"), "left", "right", "sample_id", "vcf_sample_id", "hap", labelled("population", LOCAL_NAMES).alias("population_name"), "population", "ancestor")


def genome_ancestry(rows: DataFrame) -> DataFrame:
    """Span-weighted proportions over chromosomes."""
    mean = lambda x: divide(F.sum(F.col(x) * F.col("span")), F.sum("span")).alias(x)
    return rows.groupBy("rep", "pop", "sample_id", "vcf_sample_id").agg(mean("afr_tspop"), mean("eur_tspop"), F.sum("span").alias("span"))


def with_q(ancestry: DataFrame, q: DataFrame) -> DataFrame:
    """Left join of admixture proportions on (pop, vcf_sample_id); of repeated samples the last row counts."""
    last = q.groupBy("pop", F.col("iid").alias("vcf_sample_id")).agg(F.max_by(F.struct("afr_q", "eur_q"), "row_idx").alias("q"))
    return ancestry.join(last, ["pop", "vcf_sample_id"], "left").select(*ancestry.columns, "q.afr_q", "q.eur_q")


def zip_q(fam: DataFrame, q: DataFrame) -> DataFrame:
    """Sample order and proportion rows joined by place; different counts are an error."""
    joined = fam.join(q, "row_idx", "full")
    whole = F.col("iid").isNotNull() & F.col("afr_q").isNotNull()
    row = F.when(whole, F.col("row_idx")).otherwise(F.raise_error(F.lit("sample and proportion rows differ in number")))
    return joined.withColumn("row_idx", row).select("row_idx", F.split("iid", "_", 2)[0].alias("pop"), "iid", "afr_q", "eur_q")


def admixture_labels(fam: DataFrame, metadata: DataFrame) -> DataFrame:
    """The supervised label of each sample in file order; a sample without metadata is an error."""
    joined = fam.join(metadata.select("fid", "iid", "supervised_label"), ["fid", "iid"], "left")
    missing = F.raise_error(F.concat(F.lit("no metadata for "), F.col("iid")))
    return joined.withColumn("supervised_label", F.coalesce("supervised_label", missing)).select("row_idx", "fid", "iid", "supervised_label")
