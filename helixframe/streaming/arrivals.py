"""Running totals over statistics files as they arrive: every genome aggregate is a sum of chromosome rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import columns


def arriving(spark: SparkSession, path: str, table: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of a statistics table's Parquet files."""
    schema = ", ".join(f"{n} {t}" for n, t in columns(table))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def totals(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums so far by key; the state has one row for each key, not for each arrival."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def keep_current(stream: DataFrame, path: str, checkpoint: str):
    """Write the totals as a table that each batch replaces, until what has arrived is read."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
