"""Binary genotype files (.bed, .bim, .fam) as a Python data source: two bits a call, variant by variant.

A path is the common name of one set of three files, or a folder of sets that share ``samples.fam``, as the writer makes
it: one set for each partition, in order, each valid by itself. Files are opened through Arrow's file systems, so any
store that those reach will do. A reader's partition is a range of variants of one set.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the format: its first bytes, and the copies of the first allele by code (-1: missing).
MAGIC = b"\x6c\x1b\x01"
COPIES = (2, -1, 1, 0)
COLUMNS = "chrom string, id string, position long, first string, second string, calls array<int>"
#: Variants of one reading partition, and of one Arrow batch.
RANGE, BATCH = 20_000, 500


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _lines(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """The file's lines with their ends, read in blocks."""
    with store.open_input_stream(path) as stream:
        rest = b""
        while block := stream.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            yield from (x + b"\n" for x in whole)
        if rest:
            yield rest


def unpack(raw: bytes, samples: int) -> np.ndarray:
    """(variants, samples) copies of the first allele, -1 where missing."""
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(-1, -(-samples // 4))
    codes = (rows[:, :, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
    return np.array(COPIES, dtype=np.int32)[codes.reshape(len(rows), -1)[:, :samples]]


def pack(copies: Sequence[int | None]) -> bytes:
    """One variant's calls."""
    code = {2: 0, None: 1, 1: 2, 0: 3}
    codes = np.zeros(-(-len(copies) // 4) * 4, dtype=np.uint8)
    codes[: len(copies)] = [code[c] for c in copies]
    return (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8).tobytes()


@dataclass
class Range(InputPartition):
    """Variants first to first + count of a set, and where the first one's line begins."""

    name: str
    first: int
    count: int
    line: int
    samples: int


class GenotypeReader(DataSourceReader):
    def __init__(self, path: str, per_range: int) -> None:
        self.path, self.per_range = path.rstrip("/"), per_range

    def partitions(self) -> list[Range]:
        store, path = _store(self.path)
        if store.get_file_info(path).type == fs.FileType.Directory:
            names = sorted(x.path[:-4] for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".bed") and not x.base_name.startswith("_"))
            family = f"{path}/samples.fam"
        else:
            names, family = [path], f"{path}.fam"
        samples = sum(1 for x in _lines(store, family) if x.strip())
        width, found = -(-samples // 4), []
        for name in names:
            at = variants = 0
            starts = []
            for text in _lines(store, f"{name}.bim"):
                if text.strip():
                    if variants % self.per_range == 0:
                        starts.append(at)
                    variants += 1
                at += len(text)
            size = store.get_file_info(f"{name}.bed").size
            if size != len(MAGIC) + variants * width:
                raise ValueError(f"{name}.bed has {size} bytes, {variants} variants of {samples} samples need {len(MAGIC) + variants * width}")
            found += [Range(name, i * self.per_range, min(self.per_range, variants - i * self.per_range), start, samples) for i, start in enumerate(starts)]
        return found or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        store, _ = _store(self.path)
        width, left = -(-partition.samples // 4), partition.count
        with store.open_input_file(f"{partition.name}.bed") as bed, store.open_input_file(f"{partition.name}.bim") as bim:
            if bed.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{partition.name}.bed does not begin as variant-major genotypes do")
            bed.seek(len(MAGIC) + partition.first * width)
            bim.seek(partition.line)
            rest = b""
            while left:
                n = min(BATCH, left)
                lines: list[list[str]] = []
                while len(lines) < n:
                    block = bim.read(1 << 16)
                    *whole, rest = (rest + block).split(b"\n") if block else (rest, b"")
                    lines += [x.decode().split() for x in whole if x.strip()]
                rest = b"".join("\t".join(x).encode() + b"\n" for x in lines[n:]) + rest
                lines = lines[:n]
                copies = unpack(bed.read(n * width), partition.samples)
                chrom, name, _, position, first, second = (list(c) for c in zip(*lines))
                values = pa.array(copies.ravel(), pa.int32(), mask=(copies < 0).ravel())
                calls = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * partition.samples, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array(chrom), pa.array(name), pa.array(list(map(int, position)), pa.int64()), pa.array(first), pa.array(second), calls], [c.split()[0] for c in COLUMNS.split(", ")])
                left -= n


@dataclass
class Written(WriterCommitMessage):
    number: int
    name: str
    variants: int


class GenotypeWriter(DataSourceWriter):
    def __init__(self, path: str, samples: list[str], overwrite: bool) -> None:
        self.path, self.samples, self.overwrite = path.rstrip("/"), samples, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        number, variants = TaskContext.get().partitionId(), 0
        name = f"_part-{number:06}-{uuid.uuid4().hex}"  # no task sees another's, whichever attempt ends
        with store.open_output_stream(f"{path}/{name}.bed") as bed, store.open_output_stream(f"{path}/{name}.bim") as bim:
            bed.write(MAGIC)
            for row in iterator:
                if len(row["calls"]) != len(self.samples):
                    raise ValueError(f"{row['id']} has {len(row['calls'])} calls, there are {len(self.samples)} samples")
                bed.write(pack(row["calls"]))
                bim.write("\t".join([row["chrom"], row["id"] or ".", "0", str(row["position"]), row["first"] or ".", row["second"] or "."]).encode() + b"\n")
                variants += 1
        return Written(number, name, variants)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(path)):
                if x.base_name.startswith("part-") and x.base_name.endswith((".bed", ".bim")):
                    store.delete_file(x.path)
        for m in (m for m in messages if m is not None):
            for kind in ("bed", "bim"):
                if m.variants:
                    store.move(f"{path}/{m.name}.{kind}", f"{path}/part-{m.number:06}.{kind}")
                else:
                    store.delete_file(f"{path}/{m.name}.{kind}")
        with store.open_output_stream(f"{path}/samples.fam") as out:
            out.write("".join(f"{x}\t0\t0\t0\t-9\n" for x in self.samples).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        for m in (m for m in messages if m is not None):
            for kind in ("bed", "bim"):
                store.delete_file(f"{path}/{m.name}.{kind}")


class GenotypeFiles(DataSource):
    """Options: ``samples`` (writing: family and sample id of each, tab-separated, a line each), ``perRange``."""

    @classmethod
    def name(cls) -> str:
        return "genotype_files"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> GenotypeReader:
        return GenotypeReader(self.options["path"], int(self.options.get("perRange", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> GenotypeWriter:
        return GenotypeWriter(self.options["path"], self.options["samples"].split("\n"), overwrite)


def read_genotypes(spark: SparkSession, path: str, per_range: int = RANGE) -> DataFrame:
    """(chrom, id, position, first, second, calls): a row for each variant, copies of the first allele in the order of the samples, null where missing."""
    spark.dataSource.register(GenotypeFiles)
    return spark.read.format("genotype_files").option("path", path).option("perRange", str(per_range)).load()


def write_genotypes(variants: DataFrame, samples: Sequence[str], path: str) -> None:
    """Variants in the order of chromosome and position, a set for each range of them; ``samples`` are "family, tab, id" lines."""
    variants.sparkSession.dataSource.register(GenotypeFiles)
    ordered = variants.select(*[c.split()[0] for c in COLUMNS.split(", ")]).repartitionByRange("chrom", "position").sortWithinPartitions("chrom", "position", "id")
    ordered.write.format("genotype_files").option("path", path).option("samples", "\n".join(samples)).mode("overwrite").save()


def variants(dosages: DataFrame, n: int) -> DataFrame:
    """Variants of (chrom, site_id, position, place, dosage), where ``place`` numbers ``n`` samples from 0; what has no row is missing."""
    held = F.map_from_entries(F.collect_list(F.struct("place", "dosage")))
    rows = dosages.groupBy("chrom", "site_id", "position").agg(held.alias("held"))
    calls = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at("held", i))
    return rows.select("chrom", F.col("site_id").cast("string").alias("id"), F.col("position").cast("long").alias("position"), F.lit("1").alias("first"), F.lit("0").alias("second"), calls.alias("calls"))


def calls(files: DataFrame, samples: DataFrame, rep: int) -> DataFrame:
    """Haploid calls, as the operators take them, of ``files`` and ``samples`` (place, pop, ind); missing calls have no rows."""
    each = files.select("chrom", F.col("id").cast("int").alias("site_id"), F.col("position").cast("double").alias("position"), F.posexplode("calls").alias("place", "dosage")).where("dosage IS NOT NULL")
    haps = F.explode(F.array(*[F.struct(F.lit(h).alias("hap"), (F.col("dosage") >= h).cast("int").alias("allele")) for h in (1, 2)])).alias("h")
    return each.join(F.broadcast(samples), "place").select(F.lit(rep).alias("rep"), "chrom", "pop", "site_id", "position", "ind", haps).select("rep", "chrom", "pop", "site_id", "position", "ind", "h.hap", "h.allele")
