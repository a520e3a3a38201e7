"""Typed readers and writers of the statistics tables and of the text formats they come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import finite, number

#: One schema for each statistics table; genome-level tables lack the columns in CHROM_ONLY.
SCHEMAS = {
    "ancestry": "rep int, chrom string, pop string, sample_id string, vcf_sample_id string, afr_tspop double, eur_tspop double, afr_q double, eur_q double, span double",
    "kinship": "rep int, chrom string, pop string, sample1 string, sample2 string, kinship double",
    "kinship_unrelated": "rep int, chrom string, pop string, sample1 string, sample2 string, kinship double",
    "pi_theta_stats": "rep int, chrom string, pop string, stat string, value double, ne_value double, mutation_rate double, span double, segregating_sites double, wattersons_const double",
    "sfs": "rep int, chrom string, pop string, derived_allele_count int, count double",
    "sfs_2d": "rep int, chrom string, pop1 string, pop2 string, pop1_count int, pop2_count int, count double",
    "ld_decay": "rep int, chrom string, pop string, window_start long, window_end long, distance_bin_bp long, mean_r2 double, sum_r2 double, n_pairs long",
}
CHROM_ONLY = ("chrom", "window_start", "window_end", "span")


def columns(table: str, level: str = "chrom") -> list[tuple[str, str]]:
    pairs = [tuple(x.split()) for x in SCHEMAS[table].split(", ")]
    drop = () if level == "chrom" else tuple(x for x in CHROM_ONLY if not (table == "ancestry" and x == "span"))
    return [p for p in pairs if p[0] not in drop]


def read_tsv(spark: SparkSession, path: str | Sequence[str], table: str, level: str = "chrom") -> DataFrame:
    """A statistics table from text: empty and nan fields are null, columns are found by name."""
    raw = spark.read.csv(path if isinstance(path, str) else list(path), sep="\t", header=True, inferSchema=False, enforceSchema=False)
    typed = [(number(n) if t == "double" else F.expr(f"try_cast({n} AS {t})") if t != "string" else F.col(n)).alias(n) if n in raw.columns else F.lit(None).cast(t).alias(n) for n, t in columns(table, level)]
    return raw.select(typed)


def read_parquet(spark: SparkSession, path: str, table: str, level: str = "chrom", reps: Sequence[int] | None = None, chroms: Sequence[str] | None = None) -> DataFrame:
    """A partitioned statistics table; replicates and chromosomes prune partitions. Genome rows get chrom 'all'."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("rep").isin(list(reps))) if reps is not None else rows
    rows = rows.where(F.col("chrom").cast("string").isin(list(chroms))) if chroms is not None else rows
    kept = [(finite(n) if t == "double" else F.col(n).cast(t)).alias(n) for n, t in columns(table, level) if n in rows.columns]
    return rows.select(kept) if level == "chrom" else rows.select(*kept, F.lit("all").alias("chrom"))


def write(rows: DataFrame, path: str, by: Sequence[str] = ("rep", "chrom"), text: str | None = None, skip_existing: bool = False) -> None:
    """Partitioned Parquet, and optionally a tab-separated copy with a header.

    With ``skip_existing`` only partitions that the table does not have yet are written; a run that ended early goes on.
    """
    by = [b for b in by if b in rows.columns]
    if skip_existing and by and (known := _present(rows.sparkSession, path)) is not None:
        rows.join(known.select(*[F.col(b).cast(rows.schema[b].dataType) for b in by]).distinct(), by, "left_anti").write.mode("append").partitionBy(*by).parquet(path)
    else:
        rows.write.mode("ignore" if skip_existing else "overwrite").partitionBy(*by).parquet(path)
    if text is not None:
        rows.write.mode("overwrite").csv(text, sep="\t", header=True, nullValue="")


def _present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _text(rows: DataFrame, path: str, header: bool, by: Sequence[str] = ()) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).csv(path, sep="\t", header=header, nullValue="", emptyValue="")


def write_kinship_by_pop(pairs: DataFrame, path: str) -> None:
    """Kinship pairs as tab-separated files with a header, one folder for each population (pop=...)."""
    _text(pairs, path, True, ["pop"])


def write_local_ancestry(rows: DataFrame, path: str) -> None:
    """Local-ancestry segments, tab-separated without a header, in the order that other tools read."""
    _text(rows.select("chrom", "left", "right", "sample_id", "vcf_sample_id", "hap", "population_name", "population", "ancestor"), path, False)


def write_global_ancestry(rows: DataFrame, path: str) -> None:
    """Global ancestry with a header; proportions are named AFR_prop and EUR_prop."""
    _text(rows.select("sample_id", "vcf_sample_id", F.col("afr_prop").alias("AFR_prop"), F.col("eur_prop").alias("EUR_prop"), "span"), path, True)


def metadata(spark: SparkSession, pops: Sequence[str], sample_size: int, free: str = "ADX") -> DataFrame:
    """(fid, iid, pop, supervised_label, original_order): ``sample_size`` samples of each population; those of ``free`` have label -."""
    order = F.col("id").cast("int")
    pop = F.get(F.array(*[F.lit(p) for p in pops]), F.floor(F.col("id") / sample_size).cast("int"))
    rows = spark.range(len(pops) * sample_size).select(order.alias("original_order"), pop.alias("pop"), F.concat_ws("_", pop, (F.col("id") % sample_size + 1).cast("string")).alias("iid"))
    return rows.select(F.lit("0").alias("fid"), "iid", "pop", F.when(F.col("pop") == free, "-").otherwise(F.col("pop")).alias("supervised_label"), "original_order")


def write_metadata(rows: DataFrame, path: str) -> None:
    """Sample metadata with a header, in their original order."""
    _text(rows.select("fid", "iid", "pop", "supervised_label", "original_order").orderBy("original_order"), path, True)


def write_keep_list(rows: DataFrame, path: str) -> None:
    """Family and sample ids, tab-separated without a header."""
    _text(rows.select("fid", "iid"), path, False)


def write_labels(labels: DataFrame, path: str) -> None:
    """One supervised label a line, in the order of the sample file."""
    labels.orderBy("row_idx").select("supervised_label").write.mode("overwrite").text(path)


def write_vcf(variants: DataFrame, samples: Sequence[str], path: str, zero_based: bool = True) -> None:
    """Variants (chrom, position, id, ref, alt, genotypes) as VCF lines in order; positions are written from 1.

    The header is a line set of its own at the start of the first file: lines are sorted by range, so files follow each other.
    """
    position = (F.col("position") + (1 if zero_based else 0)).cast("long")
    dot = lambda c: F.coalesce(F.col(c), F.lit("."))
    lines = variants.select(F.lit(1).alias("_part"), F.col("chrom").alias("_chrom"), position.alias("_at"), F.concat_ws("\t", "chrom", position.cast("string"), dot("id"), dot("ref"), dot("alt"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join("genotypes", "\t")).alias("value"))
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    top = variants.sparkSession.createDataFrame([(0, "", i, x) for i, x in enumerate(head)], "_part int, _chrom string, _at long, value string")
    top.unionByName(lines).orderBy("_part", F.length("_chrom"), "_chrom", "_at").select("value").write.mode("overwrite").text(path)


def require_units(rows: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, or an error that names the first expected unit (replicate, chromosome) without any."""
    missing = expected.select(*keys).distinct().join(rows.select(*keys).distinct(), list(keys), "left_anti")
    if first := missing.orderBy(*keys).first():
        raise FileNotFoundError("no rows for " + ", ".join(f"{k} {first[k]}" for k in keys))
    return rows


def chromosome(chroms: Sequence[str], index: int) -> str:
    """A chromosome by its 1-based place."""
    if not 1 <= index <= len(chroms):
        raise IndexError(f"chromosome index {index} is not in 1..{len(chroms)}")
    return chroms[index - 1]


def task_grid(tasks: DataFrame, task: str, reps: int, chroms: Sequence[str]) -> DataFrame:
    """Replicate and chromosome of 1-based task numbers, chromosome by chromosome; others are an error."""
    t = F.col(task)
    inside = F.when(t.between(1, reps * len(chroms)), t).otherwise(F.raise_error(F.concat(F.lit("task out of range: "), t.cast("string"))))
    return tasks.withColumn("rep", (F.pmod(inside - 1, F.lit(reps)) + 1).cast("int")).withColumn("chrom", F.get(F.array(*[F.lit(c) for c in chroms]), F.floor((t - 1) / reps).cast("int")))


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=False).where(F.length(F.trim("value")) > 0)
    return lines.select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("_line"))


def _numbered(rows: DataFrame) -> DataFrame:
    """0-based line numbers: rows of one partition are numbered in order, and partitions follow each other by their sizes.

    ``_line`` has the partition in its upper bits, as the text reader deals out a file in order.
    """
    part = F.shiftright("_line", 33)
    placed = rows.withColumn("_part", part)
    inside = placed.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy("_line")) - 1)
    before = W.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    starts = placed.groupBy(F.col("_part").alias("_at")).count().select("_at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return inside.join(starts, F.col("_part") == F.col("_at")).withColumn("row_idx", F.col("_before") + F.col("_n")).drop("_part", "_n", "_at", "_before", "_line")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, fid, iid) in file order; blank lines do not count."""
    return _numbered(_fields(spark, path).select("_line", F.col("f")[0].alias("fid"), F.col("f")[1].alias("iid"))).select("row_idx", "fid", "iid")


def read_q(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, afr_q, eur_q): the first column is AFR."""
    return _numbered(_fields(spark, path).select("_line", F.col("f")[0].cast("double").alias("afr_q"), F.col("f")[1].cast("double").alias("eur_q"))).select("row_idx", "afr_q", "eur_q")


def read_kin0(spark: SparkSession, path: str, rep: int, pop: str, chrom: str | None = None) -> DataFrame:
    """Kinship pairs from a white-space table; the first id's column may be written #IID1."""
    fields = _fields(spark, path)
    header = fields.orderBy("_line").first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = [x.lstrip("#") for x in header["f"]]
    at = {n: names.index(n) for n in ("IID1", "IID2", "KINSHIP")}
    rows = fields.where(F.col("f")[at["IID1"]].isin("IID1", "#IID1") == F.lit(False))
    out = [F.lit(rep).alias("rep"), F.lit(chrom).alias("chrom"), F.lit(pop).alias("pop"), F.col("f")[at["IID1"]].alias("sample1"), F.col("f")[at["IID2"]].alias("sample2"), number(F.col("f")[at["KINSHIP"]]).alias("kinship")]
    return rows.select(*[x for x, keep in zip(out, (True, chrom is not None, True, True, True, True)) if keep])


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, position, id, ref, alt, file_order, genotypes) of a VCF's records; positions are 1-based."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("file_order")).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    return lines.select(f[0].alias("chrom"), f[1].cast("long").alias("position"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"), "file_order", F.transform(F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))), lambda g: F.split(g, ":")[0]).alias("genotypes"))


def read_global_ancestry(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Global ancestry of several populations, each from its own file; a missing span is 1."""
    out = None
    for pop, path in paths.items():
        raw = spark.read.csv(path, sep="\t", header=True)
        span = number("span") if "span" in raw.columns else F.lit(None).cast("double")
        rows = raw.select(F.lit(pop).alias("pop"), "sample_id", "vcf_sample_id", number("AFR_prop").alias("afr_tspop"), number("EUR_prop").alias("eur_tspop"), F.coalesce(span, F.lit(1.0)).alias("span"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True).select("fid", "iid", "pop", "supervised_label", F.col("original_order").try_cast("int").alias("original_order"))
