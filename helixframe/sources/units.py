"""Tables that are written unit by unit (a replicate's chromosome), with a manifest of what is complete.

A unit counts once the manifest, a small table beside the data, has its row count; it is added only after the unit's rows were
written and counted again where they are. What a run that ended early left of a unit is replaced by the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(unit, rows) of the complete units, or None before any is; a unit's last entry counts."""
    try:
        return spark.read.parquet(f"{path.rstrip('/')}_manifest")
    except AnalysisException:
        return None


def _same(units: DataFrame, keys: Sequence[str], like: DataFrame) -> DataFrame:
    return units.select(*[F.col(k).cast(like.schema[k].dataType).alias(k) for k in keys]).distinct()


def missing(expected: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The expected units that the manifest does not have."""
    wanted, known = expected.select(*keys).distinct(), manifest(expected.sparkSession, path)
    return wanted if known is None else wanted.join(_same(known, keys, expected), list(keys), "left_anti")


def write_units(rows: DataFrame, expected: DataFrame, path: str, keys: Sequence[str] = ("rep", "chrom")) -> int:
    """Write the rows of the expected units that are not complete; returns how many units that were.

    Partitions of these units alone are overwritten. Units without any row are an error that names the first, after
    all others were committed.
    """
    keys, spark = list(keys), rows.sparkSession
    todo = missing(expected, path, keys)
    todo = F.broadcast(spark.createDataFrame(todo.collect(), todo.schema))  # one row for each unit: fixed before the table changes
    number = todo.count()
    if not number:
        return 0
    rows.join(_same(todo, keys, rows), keys, "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    written = spark.read.parquet(path)
    done = written.join(F.broadcast(_same(todo, keys, written)), keys, "left_semi")
    counts = done.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(F.count("*").alias("rows"))  # texts, as partition types are inferred anew
    counts.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}_manifest")
    empty = missing(todo, path, keys).orderBy(*keys).first()
    if empty:
        raise ValueError("no rows for " + ", ".join(f"{k} {empty[k]}" for k in keys))
    return number


def read_units(spark: SparkSession, path: str, keys: Sequence[str] = ("rep", "chrom")) -> DataFrame:
    """The rows of complete units only."""
    known, table = manifest(spark, path), spark.read.parquet(path)
    return table.where("false") if known is None else table.join(F.broadcast(_same(known, keys, table)), list(keys), "left_semi")
