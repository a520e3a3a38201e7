"""Unit-wise tables: half-written, empty and complete units."""

import pytest
from pyspark.sql import functions as F

from helixframe.sources import units

SCHEMA = "rep int, chrom string, x int"


def test_runs_go_on_where_the_last_one_ended(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = spark.createDataFrame([(rep, c, 10 * rep + k) for rep in (1, 2) for c in ("1", "X") for k in range(3)], SCHEMA)
    expected = rows.select("rep", "chrom").distinct()
    # A run that ended early: one complete unit, another with a part of its rows and no entry.
    assert units.write_units(rows.where("rep = 1 AND chrom = '1'"), expected.where("rep = 1 AND chrom = '1'"), path) == 1
    rows.where("rep = 1 AND chrom = 'X'").limit(1).withColumn("x", F.lit(-1)).write.mode("append").partitionBy("rep", "chrom").parquet(path)
    assert units.read_units(spark, path).count() == 3
    assert {tuple(r) for r in units.missing(expected, path, ["rep", "chrom"]).collect()} == {(1, "X"), (2, "1"), (2, "X")}
    changed = rows.withColumn("x", F.when(F.col("chrom") == "1", F.col("x") + 100).otherwise(F.col("x")))
    assert units.write_units(changed, expected, path) == 3
    got = sorted((r.rep, str(r.chrom), r.x) for r in units.read_units(spark, path).collect())
    assert got == sorted((r.rep, r.chrom, r.x) for r in changed.where("rep = 2 OR chrom = 'X'").unionByName(rows.where("rep = 1 AND chrom = '1'")).collect())
    assert units.write_units(rows, expected, path) == 0  # all is there
    assert sorted((int(r.rep), r.chrom, r.rows) for r in units.manifest(spark, path).collect()) == [(1, "1", 3), (1, "X", 3), (2, "1", 3), (2, "X", 3)]


def test_an_empty_unit_is_an_error_that_keeps_the_others(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = spark.createDataFrame([(1, "1", 5)], SCHEMA)
    expected = spark.createDataFrame([(1, "1"), (1, "2")], "rep int, chrom string")
    with pytest.raises(ValueError, match="no rows for rep 1, chrom 2"):
        units.write_units(rows, expected, path)
    assert [tuple(r) for r in units.missing(expected, path, ["rep", "chrom"]).collect()] == [(1, "2")]
    assert units.write_units(spark.createDataFrame([(1, "2", 6)], SCHEMA), expected, path) == 1
    assert units.read_units(spark, path).count() == 2
