"""Readers, writers, streams and the size model's published trajectories."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe.operators import ne_model
from helixframe.sources import tables
from helixframe.streaming import arrivals

# The published sizes for epochs (1, 6, 8) and (1, 9, 5).
SMALL = [493.7874, 5755.8703, 15296.0328, 58666.1031, 146967.1421, 260312.8139, 436921.0291, 447164.9165, 457648.9783, 468378.8455, 479360.2811, 490599.1834, 502101.5888, 513873.6753, 525921.7657]
LARGE = [*SMALL[:7], 858109.3961, 1845355.3309, 3322796.2758, 3400701.3175, 3480432.8916, 3562033.8225, 3645547.9384, 3731020.0950]


@pytest.mark.parametrize("epochs,expected", [((1, 6, 8), SMALL), ((1, 9, 5), LARGE)])
def test_trajectories(spark, epochs, expected):
    rows = ne_model.trajectory(spark, ne_model.Epochs(*epochs)).orderBy("generation").collect()
    assert [round(r.ne, 4) for r in rows] == expected
    assert all(r.ne == pytest.approx(r.admix_ne + r.import_ne) for r in rows if r.epoch == 2)


def test_history_of_generations(spark):
    rows = {r.generation: r for r in ne_model.history(ne_model.generations(spark), ne_model.periods(spark)).collect()}
    # 1625-1650: half of 1620-1630 and two whole periods.
    assert (rows[1].imported, rows[1].births, rows[1].birth_rate) == pytest.approx((75 + 110 + 301, 4 + 51 + 223, 22.4))
    assert rows[7].imported == pytest.approx(61852.5) and rows[7].birth_rate == pytest.approx(46.523696, abs=1e-5)
    assert rows[10].truncated and rows[11].births is None
    assert rows[1].pop_end == pytest.approx(1568) and rows[4].pop_end == pytest.approx(81481.5) and rows[10].pop_end == pytest.approx(3630336)


def test_epochs_are_checked():
    for bad in ((8, 3, 4), (1, 6, 7), (0, 0, 15), (1.5, 6, 8)):
        with pytest.raises(ValueError):
            ne_model.Epochs(*bad)


def test_mixing_proportions(spark):
    rows = ne_model.mixing_proportions(spark, ne_model.Epochs(7, 3, 5)).orderBy("g").collect()
    assert rows[1].s_afr == pytest.approx(0.90482) and rows[6].s_afr == pytest.approx(0.130456) and rows[0].h == pytest.approx(0)
    assert all(r.s_afr + r.s_eur + r.h == pytest.approx(1) for r in rows)


def test_text_round_trip_types_nulls_and_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "1", "A", "s", "v", 0.5, 0.5, None, None, 1.0), (2, "X", "A", "s", "v", 0.5, 0.5, 0.25, 0.75, 1.0)], tables.SCHEMAS["ancestry"])
    tables.write(rows, f"{tmp_path}/p", text=f"{tmp_path}/t")
    back = tables.read_tsv(spark, f"{tmp_path}/t", "ancestry")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    pruned = tables.read_parquet(spark, f"{tmp_path}/p", "ancestry", reps=[2], chroms=["X"])
    assert pruned.count() == 1 and "PartitionFilters: [isnotnull(rep" in pruned._jdf.queryExecution().toString()
    assert dict(tables.columns("ancestry", "genome")).keys() >= {"span"} and "chrom" not in dict(tables.columns("sfs", "genome"))
    more = rows.where("rep = 1").withColumn("value_of_old", F.lit(1)).drop("value_of_old").withColumn("span", F.lit(9.0)).unionByName(rows.where("rep = 2").withColumn("rep", F.lit(3)))
    tables.write(more, f"{tmp_path}/p", skip_existing=True)  # replicate 1 is there and stays, 3 is new
    assert sorted((r.rep, r.span) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    tables.write(rows, f"{tmp_path}/new", skip_existing=True)
    assert spark.read.parquet(f"{tmp_path}/new").count() == 2


def test_sample_and_pair_files(spark, tmp_path):
    (tmp_path / "a.fam").write_text("0 A_1 0 0 0 -9\n\n0\tA_2 0 0 0 -9\n")
    (tmp_path / "a.Q").write_text("0.25 0.75\n1e-05 0.99999\n")
    (tmp_path / "a.kin0").write_text("#FID1 IID1 IID2 NSNP KINSHIP\n0 A_1 A_2 10 0.125\n0 A_1  A_3 10 nan\n")
    (tmp_path / "b.kin0").write_text("#IID1\tIID2\tKINSHIP\nA_1\tA_2\t-0.5\n")
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n1\t7\t.\tA\tC\t.\t.\t.\tGT:DP\t0|1:3\t1|1:2\n")
    (tmp_path / "g.tsv").write_text("sample_id\tvcf_sample_id\tAFR_prop\tEUR_prop\nA_1\tA_1\t0.5\t0.5\n")
    (tmp_path / "m.tsv").write_text("fid\tiid\tpop\tsupervised_label\toriginal_order\n0\tA_1\tA\t-\t3\n")
    assert [tuple(r) for r in tables.read_fam(spark, f"{tmp_path}/a.fam").collect()] == [(0, "0", "A_1"), (1, "0", "A_2")]
    assert [tuple(r) for r in tables.read_q(spark, f"{tmp_path}/a.Q").collect()] == [(0, 0.25, 0.75), (1, 1e-05, 0.99999)]
    assert [tuple(r) for r in tables.read_kin0(spark, f"{tmp_path}/a.kin0", 1, "A", "2").collect()] == [(1, "2", "A", "A_1", "A_2", 0.125), (1, "2", "A", "A_1", "A_3", None)]
    assert tables.read_kin0(spark, f"{tmp_path}/b.kin0", 1, "A").first().kinship == -0.5
    vcf = tables.read_vcf(spark, f"{tmp_path}/a.vcf").first()
    assert (vcf.chrom, vcf.position, vcf.genotypes) == ("1", 7, ["0|1", "1|1"])
    assert tables.read_global_ancestry(spark, {"A": f"{tmp_path}/g.tsv"}).first().span == 1.0
    assert tables.read_metadata(spark, f"{tmp_path}/m.tsv").first().original_order == 3


def lines(folder):
    return [x for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines()]


def test_files_for_other_tools(spark, tmp_path):
    kin = spark.createDataFrame([(1, "A", "A_1", "A_2", 0.5), (1, "B", "B_1", "B_2", None)], "rep int, pop string, sample1 string, sample2 string, kinship double")
    tables.write_kinship_by_pop(kin, f"{tmp_path}/kin")
    assert lines(tmp_path / "kin" / "pop=B") == ["rep\tsample1\tsample2\tkinship", "1\tB_1\tB_2\t"]
    local = spark.createDataFrame([("chr1", 0.0, 5.0, "A_1", "A_1", 2, "EUR", 1, 7)], "chrom string, left double, right double, sample_id string, vcf_sample_id string, hap int, population_name string, population int, ancestor int")
    tables.write_local_ancestry(local, f"{tmp_path}/local")
    assert lines(tmp_path / "local") == ["chr1\t0.0\t5.0\tA_1\tA_1\t2\tEUR\t1\t7"]
    tables.write_global_ancestry(spark.createDataFrame([("A", "A_1", "A_1", 0.25, 0.75, 9.0)], "pop string, sample_id string, vcf_sample_id string, afr_prop double, eur_prop double, span double"), f"{tmp_path}/global")
    back = tables.read_global_ancestry(spark, {"A": f"{tmp_path}/global"}).first()
    assert (back.afr_tspop, back.eur_tspop, back.span) == (0.25, 0.75, 9.0)
    meta = tables.metadata(spark, ["AFR", "EUR", "ADX"], 2)
    tables.write_metadata(meta, f"{tmp_path}/meta")
    assert [tuple(r) for r in tables.read_metadata(spark, f"{tmp_path}/meta").orderBy("original_order").collect()] == [("0", "AFR_1", "AFR", "AFR", 0), ("0", "AFR_2", "AFR", "AFR", 1), ("0", "EUR_1", "EUR", "EUR", 2), ("0", "EUR_2", "EUR", "EUR", 3), ("0", "ADX_1", "ADX", "-", 4), ("0", "ADX_2", "ADX", "-", 5)]
    tables.write_keep_list(meta.where("pop = 'EUR'").orderBy("original_order"), f"{tmp_path}/keep")
    assert lines(tmp_path / "keep") == ["0\tEUR_1", "0\tEUR_2"]
    tables.write_labels(spark.createDataFrame([(1, "-"), (0, "AFR")], "row_idx long, supervised_label string"), f"{tmp_path}/pop")
    assert lines(tmp_path / "pop") == ["AFR", "-"]
    variants = spark.createDataFrame([("10", 4, None, "A", "T", ["0|0", "1|1"]), ("2", 6, "rs1", "A", "C", ["0|1", "1|0"]), ("2", 1, None, "G", "C", ["0|0", "0|1"])], "chrom string, position int, id string, ref string, alt string, genotypes array<string>")
    tables.write_vcf(variants, ["S1", "S2"], f"{tmp_path}/vcf")
    assert lines(tmp_path / "vcf")[2].split("\t")[-3:] == ["FORMAT", "S1", "S2"]
    assert [(r.chrom, r.position, r.genotypes) for r in tables.read_vcf(spark, f"{tmp_path}/vcf").orderBy("file_order").collect()] == [("2", 2, ["0|0", "0|1"]), ("2", 7, ["0|1", "1|0"]), ("10", 5, ["0|0", "1|1"])]


def test_labels_sources_and_the_long_table(spark):
    epochs = ne_model.Epochs()
    ne, shares = ne_model.trajectory(spark, epochs), ne_model.mixing_proportions(spark, epochs)
    named = ne_model.labelled_epochs(ne)
    assert ne_model.validate(named, ne_model.overlap_table(spark), shares, epochs) is named
    with pytest.raises(ValueError, match="sizes.*sums of the second epoch"):
        ne_model.validate(ne.withColumn("ne", -F.col("ne")), ne_model.overlap_table(spark), shares, epochs)
    with pytest.raises(ValueError, match="epochs, .*generation numbers"):
        ne_model.validate(ne.withColumn("generation", F.col("generation") + 1), ne_model.overlap_table(spark), shares, epochs)
    rows = ne_model.combined(spark, epochs)
    assert rows.count() == 15 + 2 * 376 and rows.where("population = 'aa' AND epoch LIKE 'Epoch 3:%'").count() == 8
    sizes = {(r.population, r.year): r.ne for r in rows.where("population <> 'aa'").collect()}
    assert sizes["afr", 2000] == pytest.approx(14474 / math.exp(-0.0166 * 5115 / 25)) and sizes["eur", 1625] == pytest.approx(sizes["eur", 2000] * math.exp(-0.0195 * 15))
    old = {r.year: (r.afr, r.eur) for r in ne_model.source_sizes(spark.createDataFrame([(y,) for y in (-10_000, -30_000, -60_000, -150_000)], "year int")).collect()}
    assert old[-30_000] == (14474, 1861) and old[-60_000] == (7310, None) and old[-150_000] == (None, None)
    assert old[-10_000][1] == pytest.approx(1032 * math.exp(0.00307 * (23_000 - 12_000) / 25))
    grid = ne_model.on_generations(rows)
    assert grid.where("population = 'eur'").count() == 15 and grid.where("generation = 15").select("year").distinct().first().year == 2000
    assert {r.g: (r.sources, r.proportions[0]) for r in ne_model.sources(shares).where("g in (1, 2, 9)").collect()}[9][0] == ["ADX_G8"]
    assert ne_model.mixing_long(shares).where("abs(perc - 100 * proportion) > 1e-9").count() == 0 and ne_model.mixing_long(shares).count() == 45


def test_missing_units_chromosome_index_and_tasks(spark):
    have = spark.createDataFrame([(1, "1"), (2, "1")], "rep int, chrom string")
    with pytest.raises(FileNotFoundError, match="rep 3"):
        tables.require_units(have, spark.createDataFrame([(3, "1")], have.schema), ["rep", "chrom"])
    for index in (0, 3):
        with pytest.raises(IndexError):
            tables.chromosome(["1", "2"], index)
    grid = tables.task_grid(spark.range(1, 7).toDF("t"), "t", 3, ["1", "2"]).orderBy("t").collect()
    assert [(r.rep, r.chrom) for r in grid] == [(1, "1"), (2, "1"), (3, "1"), (1, "2"), (2, "2"), (3, "2")]
    for t in (0, 7):
        with pytest.raises(Exception, match="task out of range"):
            tables.task_grid(spark.range(t, t + 1).toDF("t"), "t", 3, ["1", "2"]).collect()


def test_stream_of_arriving_chromosomes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "1", "A", 2, 3.0), (1, "2", "A", 2, 4.0), (1, "2", "A", 5, 1.0)], tables.SCHEMAS["sfs"])
    for chrom in ("1", "2"):
        rows.where(f"chrom = '{chrom}'").write.mode("append").parquet(f"{tmp_path}/in")
    stream = arrivals.totals(arrivals.arriving(spark, f"{tmp_path}/in", "sfs", 1), ["rep", "pop", "derived_allele_count"], ["count"])
    arrivals.keep_current(stream, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "A", 2, 7.0), (1, "A", 5, 1.0)}


def test_registered_queries_have_sql_or_tests():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {q for q in queries if q not in sql and not q.startswith("op") and q != "pipeline"} == {"unrelated_set", "unrelated_pairs", "ld_prune", "admixture_em"}
