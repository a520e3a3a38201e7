"""Domain tables from the general test tables: genotypes, segments, statistics, samples and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POPS = ["AFR", "EUR", "ADX"]
CHROMS = ["1", "2", "3", "4"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haploid allele calls from vectors: a dimension is a site, a vector a haploid, two neighbouring vectors an individual.

    The first one's label is the population. One shuffle by individual; nothing is numbered over a whole population.
    """
    v = table(spark, sf_dir, "embeddings").withColumn("pair", F.floor(F.col("vec_id") / 2))
    two = v.groupBy("pair").agg(F.count("*").alias("n"), F.min_by("label", "vec_id").alias("label"), F.min_by("embedding", "vec_id").alias("first"), F.max_by("embedding", "vec_id").alias("second")).where("n = 2")
    pop = F.when(F.col("label") <= 2, "AFR").when(F.col("label") <= 5, "EUR").otherwise("ADX")
    s, hap = F.col("site_id"), lambda x, threshold: (x.cast("double") > threshold).cast("int")
    sites = two.select((F.lit(1) + F.col("pair") % 2).cast("int").alias("rep"), pop.alias("pop"), F.floor(F.col("pair") / 2).cast("int").alias("ind"), F.posexplode(F.arrays_zip("first", "second")).alias("site_id", "x"))
    both = F.array(*[F.struct(F.lit(i).alias("hap"), hap(F.col(f"x.{c}"), F.lit(0.05) * (s % 8)).alias("allele")) for i, c in ((1, "first"), (2, "second"))])
    place = [(F.lit(1) + F.floor(s / 16)).cast("string").alias("chrom"), "pop", "site_id", ((s % 16 + 1) * 1000).cast("double").alias("position")]
    return sites.select("rep", *place, "ind", F.explode(both).alias("c")).select("rep", "chrom", "pop", "site_id", "position", "ind", "c.hap", "c.allele")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each chromosome of each replicate that occurs."""
    reps = table(spark, sf_dir, "embeddings").select((F.lit(1) + F.col("vec_id") % 2).cast("int").alias("rep")).distinct()
    return reps.withColumn("chrom", F.explode(F.array(*[F.lit(c) for c in CHROMS]))).withColumn("span", (F.lit(16000) + F.lit(1000) * F.col("chrom").cast("int")).cast("double"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestry segments from events: from one event of a user to the next."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000000").cast("double").alias("left"), "event_type")
    code = F.when(F.col("event_type").isin("click", "view"), 0).when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(2)
    following = W.partitionBy("user_id").orderBy("left", "event_id")
    rows = e.withColumn("right", F.lead("left").over(following)).where(F.col("right").isNotNull())
    pop = F.get(F.array(*[F.lit(p) for p in POPS]), (F.col("user_id") % 3).cast("int"))
    return rows.select(F.col("user_id").alias("node"), F.floor(F.col("user_id") / 2).cast("long").alias("ind"), pop.alias("pop"), "left", "right", code.alias("population"), F.col("event_id").alias("ancestor"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics rows from line items: replicate, population, chromosome, bin, sum, pairs and value."""
    chrom = (F.col("l_suppkey") % 22 + 1).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("rep"), F.col("l_returnflag").alias("pop"), chrom.alias("chrom"), (F.col("l_quantity") * 5000).cast("long").alias("distance_bin_bp"),
        F.col("l_discount").alias("sum_r2"), F.col("l_quantity").cast("long").alias("n_pairs"), F.col("l_quantity").cast("int").alias("derived_allele_count"), F.col("l_tax").alias("value"),
        F.round(F.col("l_extendedprice")).alias("count"), F.col("l_linestatus").alias("pop2"), (F.col("l_partkey") % 50).cast("int").alias("other_count"),
    )


def kinship_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinship-shaped pairs from orders: a customer and the one 7 * key mod 100 + 1 further on."""
    o = table(spark, sf_dir, "orders")
    other = F.col("o_custkey") + F.col("o_orderkey") * 7 % 100 + 1
    sample = lambda x: F.concat(F.col("o_orderstatus"), F.lit("_"), x.cast("string"))
    return o.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("rep"), F.col("o_orderstatus").alias("pop"), sample(F.col("o_custkey")).alias("sample1"), sample(other).alias("sample2"), (F.round(F.col("o_totalprice")) / 4_000_000 - 0.05).alias("kinship"))


def fam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in file order from customers."""
    pop = F.get(F.array(*[F.lit(p) for p in POPS]), (F.col("c_nationkey") % 3).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.lit("0").alias("fid"), F.concat_ws("_", pop, F.col("c_custkey").cast("string")).alias("iid"), pop.alias("pop"))


def q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admixture proportions by place."""
    share = F.pmod(F.col("c_custkey") * 37, F.lit(101)) / F.lit(100.0)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), share.alias("afr_q"), (1 - share).alias("eur_q"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant records with repeated positions, indels and multi-allelic sites, from line items."""
    base = lambda x: F.get(F.array(*[F.lit(b) for b in ("A", "C", "G", "T", "AC")]), (x % 5).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 22 + 1).cast("string").alias("chrom"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("position"), base(F.col("l_partkey")).alias("ref"),
        F.when(F.col("l_quantity") > 45, F.concat(base(F.col("l_orderkey")), F.lit(",T"))).otherwise(base(F.col("l_orderkey"))).alias("alt"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("file_order"),
    )
