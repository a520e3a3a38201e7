"""Packed genotypes: two bits a call, site by site, and the matrices that tasks make of them.

A call's code is 0 where the individual has none, else its dosage and 1. Codes of PER_WORD neighbouring individuals
are one long: the sum of what each allele adds, so packing is one partial aggregation, and a site of a population is a
few longs instead of a row for each allele.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .genotype import SITE

#: Individuals of one long; 62 bits, so that sums never touch the sign.
PER_WORD = 31
_SHIFTS = 2 * np.arange(PER_WORD, dtype=np.int64)


def words(calls: DataFrame, by: list[str] = ["pop"]) -> DataFrame:
    """(site, by, word, bits, n_called, n_alt): the codes of PER_WORD individuals; ``ind`` numbers them, haplotypes are 1 and 2.

    As everywhere here a missing allele (negative) counts as the reference in dosages, and is not called.
    """
    adds = (F.col("hap") == 1).cast("long") + (F.col("allele") > 0).cast("long")
    field = F.expr(f"CAST(2 * (ind % {PER_WORD}) AS INT)")
    return calls.groupBy(*SITE, *by, F.expr(f"CAST(ind DIV {PER_WORD} AS INT)").alias("word")).agg(
        F.sum(F.call_function("shiftleft", adds, field)).alias("bits"), F.count(F.when(F.col("allele") >= 0, 1)).alias("n_called"), F.count(F.when(F.col("allele") == 1, 1)).alias("n_alt")
    )


def sites(calls: DataFrame, by: list[str] = ["pop"]) -> DataFrame:
    """(site, by, n_called, n_alt, codes): one row for each site and group, ``codes`` its words in order."""
    each = F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("codes")
    return words(calls, by).groupBy(*SITE, *by).agg(F.sum("n_called").alias("n_called"), F.sum("n_alt").alias("n_alt"), each)


def codes(column: pa.ChunkedArray | pa.Array, first: int = 0) -> np.ndarray:
    """(rows, individuals) codes of an Arrow column of word lists; the first individual is that of word ``first``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten()
    word, bits = np.asarray(flat.field(0)) - first, np.asarray(flat.field(1))
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    out = np.zeros((len(lists), int(word.max(initial=-1)) + 1), dtype=np.int64)
    out[row, word] = bits
    return ((out[:, :, None] >> _SHIFTS) & 3).astype(np.uint8).reshape(len(lists), -1)


def matrix(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the individuals that have any call, dosages with 0 for none, whether each has a call), as doubles."""
    who = np.flatnonzero(coded.any(axis=0))
    held = coded[:, who]
    return who, np.maximum(held.astype(np.float64) - 1, 0), (held > 0).astype(np.float64)


def unpacked(rows: DataFrame) -> DataFrame:
    """``rows`` with (ind, dosage) of each call in place of ``codes``."""
    others = [c for c in rows.columns if c != "codes"]
    each = rows.select(*others, F.explode("codes").alias("w")).select(*others, "w.word", "w.bits", F.posexplode(F.sequence(F.lit(0), F.lit(PER_WORD - 1))).alias("place", "_"))
    code = F.expr("CAST(shiftright(bits, 2 * place) & 3 AS INT)")
    return each.select(*others, (F.col("word") * PER_WORD + F.col("place")).alias("ind"), (code - 1).alias("dosage")).where("dosage >= 0")


def squared_correlations(a: np.ndarray, held_a: np.ndarray, b: np.ndarray, held_b: np.ndarray) -> np.ndarray:
    """Squared correlation of each site of a with each of b over the individuals that have both; not finite for flat ones.

    Moments are integers, which doubles hold exactly.
    """
    xy = a @ b.T
    if held_a.all() and held_b.all():
        n, x, y, xx, yy = a.shape[1], a.sum(axis=1)[:, None], b.sum(axis=1)[None, :], (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    else:
        n, x, y, xx, yy = held_a @ held_b.T, a @ held_b.T, held_a @ b.T, (a * a) @ held_b.T, held_a @ (b * b).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return (n * xy - x * y) ** 2 / ((n * xx - x * x) * (n * yy - y * y))


def squared_differences(a: np.ndarray, held_a: np.ndarray, b: np.ndarray, held_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each individual (column) of a with each of b, over the sites that both have: summed squared differences, and how often either is heterozygous."""
    het_a, het_b = (a == 1).astype(np.float64), (b == 1).astype(np.float64)
    return (a * a).T @ held_b + held_a.T @ (b * b) - 2 * (a.T @ b), het_a.T @ held_b, held_a.T @ het_b


def tiles(group: pa.Table, keys: list[str]) -> list[pa.Table]:
    """The tables of equal keys of a sorted copy of the group."""
    rows = group.sort_by([(k, "ascending") for k in keys]).combine_chunks()
    if not rows.num_rows:
        return []
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        codes_ = np.asarray(rows.column(k).combine_chunks().dictionary_encode().indices)
        new[1:] |= codes_[1:] != codes_[:-1]
    cuts = [*np.flatnonzero(new).tolist(), rows.num_rows]
    return [rows.slice(a, z - a) for a, z in zip(cuts, cuts[1:])]
