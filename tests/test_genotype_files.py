"""Binary genotype files: fixed bytes, round trips, and statistics of what is read back."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import kinship, ld
from helixframe.sources import genotype_files as files

CALLS = "rep int, chrom string, pop string, site_id int, position double, ind int, hap int, allele int"


def test_bytes_of_the_format(spark, tmp_path):
    assert files.pack([2, None, 1, 0, 2]) == bytes([0b11100100, 0])
    assert files.unpack(bytes([0b11100100, 0]), 5).tolist() == [[2, -1, 1, 0, 2]]
    (tmp_path / "one.bed").write_bytes(files.MAGIC + bytes([0b11100100, 0, 0b00000011, 0b11]))
    (tmp_path / "one.bim").write_text("1\trs1\t0\t100\tA\tG\n1 rs2 0 200 C T\n")
    (tmp_path / "one.fam").write_text("".join(f"0 s{i} 0 0 0 -9\n" for i in range(5)))
    got = sorted(files.read_genotypes(spark, f"{tmp_path}/one", per_range=1).collect(), key=lambda r: r.position)
    assert [tuple(r[:5]) for r in got] == [("1", "rs1", 100, "A", "G"), ("1", "rs2", 200, "C", "T")]
    assert [r.calls for r in got] == [[2, None, 1, 0, 2], [0, 2, 2, 2, 0]]
    (tmp_path / "one.bed").write_bytes(files.MAGIC + b"\0")
    with pytest.raises(Exception, match="has 4 bytes"):
        files.read_genotypes(spark, f"{tmp_path}/one").collect()


def test_round_trip_of_dosages_and_statistics(spark, tmp_path):
    r = random.Random(2)
    rows = [(1, "1", "AB"[i % 2], s, float(1000 * s), i, h, int(r.random() < 0.5)) for s in range(25) for i in range(9) if r.random() < 0.9 for h in (1, 2)]
    calls = spark.createDataFrame(rows, CALLS).repartition(4)
    samples = spark.createDataFrame([(i, "AB"[i % 2], i) for i in range(9)], "place int, pop string, ind int")
    dosages = calls.groupBy("chrom", "site_id", "position", F.col("ind").alias("place")).agg(F.sum("allele").cast("int").alias("dosage"))
    written = files.variants(dosages, 9)
    files.write_genotypes(written, [f"0\ts{i}" for i in range(9)], f"{tmp_path}/set")
    files.write_genotypes(written, [f"0\ts{i}" for i in range(9)], f"{tmp_path}/set")  # replaces the first
    back = files.read_genotypes(spark, f"{tmp_path}/set", per_range=7)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, written.collect()))
    names = sorted(p.name for p in (tmp_path / "set").iterdir() if p.suffix == ".bim")
    positions = [int(line.split()[3]) for n in names for line in (tmp_path / "set" / n).read_text().splitlines()]
    assert positions == sorted(positions) and len(positions) == 25  # files follow each other in order
    read = files.calls(back, samples, 1)
    spans = spark.createDataFrame([(1, "1", 1e6)], "rep int, chrom string, span double")
    assert sorted(map(tuple, kinship.king_partials(read).collect())) == sorted(map(tuple, kinship.king_partials(calls).collect()))
    decay = lambda c: sorted((x["pop"], x.distance_bin_bp, round(x.sum_r2, 9), x.n_pairs) for x in ld.decay(c, spans, maf=0.0).collect())
    assert decay(read) == decay(calls)
