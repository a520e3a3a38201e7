"""KING-robust kinship from additive partials, relatedness cut-offs and per-individual means."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import cut
from . import packed
from .genotype import UNIT

CUTOFF = 0.0442
#: Samples and pairs of the largest family that is one group (either is enough), and rounds of drops before families are looked for again.
FAMILY_SAMPLES, FAMILY_PAIRS, ROUNDS = 16_384, 100_000, 8
#: Sites (by number) that one group takes, and those of them that it unpacks at a time.
SITE_BLOCK, AT_ONCE = 1_000_000, 1024
#: Numbers of individuals of one block, in whole longs.
IND_BLOCK = 1023
#: Tasks of the tiles at most, and pairs of one batch that leaves a task.
TASKS, PAIR_ROWS = 4_000, 200_000


def _sums(rows: Iterator[pa.RecordBatch], first: tuple[int, int], same: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sites that both have, [squares, het1, het2]) of each pair between two blocks of individuals, as matrices by their numbers in the blocks."""
    total = np.zeros((4, 0, 0))
    for batch in rows:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            sides = [packed.codes(part.column(c), n) for c, n in zip(("own", "own" if same else "other"), first)]
            (g, held), (h, other) = ((np.maximum(x - 1.0, 0), (x > 0).astype(np.float64)) for x in sides)
            grown = np.zeros((4, max(total.shape[1], g.shape[1]), max(total.shape[2], h.shape[1]))) if total.shape[1] < g.shape[1] or total.shape[2] < h.shape[1] else total
            if grown is not total:
                grown[:, : total.shape[1], : total.shape[2]] = total
                total = grown
            for whole, some in zip(total, (held.T @ other, *packed.squared_differences(g, held, h, other))):
                whole[: g.shape[1], : h.shape[1]] += some
    return total[0], list(total[1:])


def king_sums(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ind1, ind2, squares, het1, het2) of the pairs with a site in common, ind1 < ind2: sums over what ``keys`` (pop and
    what else is kept apart: rep and chrom, or rep) does not tell apart.

    Calls are packed, two bits each, and individuals dealt into blocks. A group is the pairs between two blocks over all their
    sites, which it takes batch by batch, so sums leave it complete and no pair is shuffled; only sites numbered
    beyond SITE_BLOCK make more groups, whose sums are added.
    """
    width, size = max(1, IND_BLOCK // packed.PER_WORD), SITE_BLOCK  # longs of a block
    coded = packed.words(calls).select(*UNIT, "pop", "site_id", F.expr(f"CAST(word DIV {width} AS INT)").alias("block"), "word", "bits").repartition(*UNIT, "pop", "site_id")
    placed = coded.groupBy(*UNIT, "pop", "site_id", "block").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("codes"))
    sites = cut(placed.groupBy(*UNIT, "pop", "site_id").agg(F.array_sort(F.collect_list(F.struct("block", "codes"))).alias("b")))
    slice_ = F.expr(f"CAST(floor(site_id / {size}) AS INT)").alias("slice")
    pairs = sites.select(*keys, slice_, F.posexplode("b").alias("place", "x"), "b").select(*keys, "slice", "x", F.explode(F.expr("slice(b, place + 1, size(b))")).alias("y"))
    same = F.col("x.block") == F.col("y.block")
    tiles = pairs.select(*keys, "slice", F.col("x.block").alias("i"), F.col("y.block").alias("j"), F.col("x.codes").alias("own"), F.when(~same, F.col("y.codes")).alias("other"))
    held = sites.select(*keys, slice_, F.explode("b.block").alias("block")).groupBy(*keys, "slice").agg(F.count_distinct("block").alias("n"))
    number = held.agg(F.sum(F.expr("n * (n + 1) DIV 2")).alias("tiles"), F.count_distinct("slice").alias("slices")).first()
    names = [*keys, "ind1", "ind2", "squares", "het1", "het2"]
    kinds = {"rep": pa.int32(), "chrom": pa.string(), "pop": pa.string(), "ind1": pa.int32(), "ind2": pa.int32()}

    def run(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *values, _, i, j = (k.as_py() for k in key)
        common, sums = _sums(rows, (i * width, j * width), i == j)
        common = np.triu(common, k=1) if i == j else common
        step = max(1, PAIR_ROWS // max(common.shape[1], 1))
        for at in range(0, len(common), step):
            x, y = np.nonzero(common[at : at + step])
            x += at
            found = [(x + i * width * packed.PER_WORD).astype(np.int32), (y + j * width * packed.PER_WORD).astype(np.int32), *(s[x, y].astype(np.int64) for s in sums)]
            yield pa.RecordBatch.from_arrays([*(pa.repeat(pa.scalar(v, kinds[k]), len(x)) for k, v in zip(keys, values)), *map(pa.array, found)], names)

    schema = ", ".join(f"{n} {dict(rep='int', chrom='string', pop='string', ind1='int', ind2='int').get(n, 'long')}" for n in names)
    by = [*keys, "slice", "i", "j"]
    parts = tiles.repartition(min(max(number.tiles or 0, 1), TASKS), *by).groupBy(*by).applyInArrow(run, schema)
    return parts if (number.slices or 0) < 2 else _summed(parts, [*keys, "ind1", "ind2"])


def king_partials(calls: DataFrame) -> DataFrame:
    """(rep, chrom, pop, ind1, ind2, squares, het1, het2): sums that add over chromosomes, ind1 < ind2."""
    return king_sums(calls, [*UNIT, "pop"])


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("squares", "het1", "het2")])


def kinship(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Kinship of each pair over what ``keys`` keeps apart: chromosome tables, or the genome without chrom."""
    return kinship_of_sums(_summed(partials, [*keys, "ind1", "ind2"]), keys)


def _kinship() -> Column:
    least = F.least("het1", "het2")
    return F.when(least > 0, F.lit(0.5) - F.col("squares") / (F.lit(4) * least)).alias("kinship")


def _name(ind: str) -> Column:
    return F.concat_ws("_", F.col("pop"), (F.col(ind) + 1).cast("string"))


def kinship_of_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Kinship of each pair of ``sums`` (keys, ind1, ind2, squares, het1, het2), which has one row for each."""
    return sums.select(*keys, _name("ind1").alias("sample1"), _name("ind2").alias("sample2"), _kinship())


def individual_means_of_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """``individual_means`` of the kinship of ``sums``; individuals are named when their means are known."""
    ends = F.explode(F.array("ind1", "ind2")).alias("ind")
    means = sums.select(*keys, ends, _kinship()).groupBy(*keys, "ind").agg(F.avg("kinship").alias("mean_kinship"))
    return means.select(*keys, _name("ind").alias("sample"), "mean_kinship")


def unrelated_set(pairs: DataFrame, keys: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """Samples that stay when the most-related one is dropped until no pair exceeds the cut-off.

    Ties go to the smaller id. Families, the connected components of pairs above the cut-off, do not
    affect each other. Where FAMILY_SAMPLES at most have close relatives, all families are one group with a matrix of who is
    close to whom; else families are looked for, and one of at most FAMILY_SAMPLES samples or FAMILY_PAIRS pairs is a group of its
    own. Of larger ones, all samples that come
    first within two steps of themselves are dropped at once, in ROUNDS rounds, until what is left falls into small
    families. That is the order of one by one: nobody within two steps of such a sample can be dropped before it, so
    until it is dropped neither its own count of relatives nor its relatives' counts change.
    """
    each = F.explode(F.array("sample1", "sample2")).alias("sample")
    samples = pairs.select(*keys, each).distinct()
    close = cut(pairs.where(F.col("kinship") > cutoff).select(*keys, "sample1", "sample2").distinct())
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    held = close.join(close.select(*keys, each).distinct().groupBy(*keys).agg(F.count("*").alias("n")), keys)
    dropped = [_dropped(held.where(F.col("n") <= FAMILY_SAMPLES), keys, keys, kinds)]
    close = cut(held.where(F.col("n") > FAMILY_SAMPLES).drop("n"))
    while not close.isEmpty():
        named = cut(families(close, keys))
        grouped = close.join(named.withColumnRenamed("sample", "sample1"), [*keys, "sample1"])
        sizes = grouped.groupBy(*keys, "family").count().join(named.groupBy(*keys, "family").agg(F.count("*").alias("n")), [*keys, "family"])
        sized = cut(grouped.join(sizes, [*keys, "family"]))
        dense = F.col("n") <= FAMILY_SAMPLES
        dropped.append(_dropped(sized.where(dense), keys, [*keys, "family"], kinds))
        small = sized.where(~dense & (F.col("count") <= FAMILY_PAIRS))
        dropped.append(small.groupBy(*keys, "family").applyInPandas(_dropper(keys), ", ".join([*(f"{k} {kinds[k]}" for k in keys), "sample string"])))
        close = cut(sized.where(~dense & (F.col("count") > FAMILY_PAIRS)).select(*keys, "sample1", "sample2"))
        for _ in range(ROUNDS if not close.isEmpty() else 0):
            first = cut(first_within_two(close, keys))
            dropped.append(first)
            for end in ("sample1", "sample2"):
                close = close.join(first.withColumnRenamed("sample", end), [*keys, end], "left_anti")
            close = cut(close)
    gone = dropped[0]
    for more in dropped[1:]:
        gone = gone.unionByName(more)
    return samples.join(gone, [*keys, "sample"], "left_anti")


def _dropped(close: DataFrame, keys: list[str], by: list[str], kinds: dict[str, str]) -> DataFrame:
    """(keys, sample): who is dropped one by one of the pairs of each group ``by``, which has ``n`` samples."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, near = {}, np.zeros((0, 0), dtype=bool)
        for batch in batches:
            if not len(near) and batch.num_rows:
                near = np.zeros((batch.column("n")[0].as_py(),) * 2, dtype=bool)
            ends = []
            for end in ("sample1", "sample2"):
                coded = batch.column(end).dictionary_encode()
                ends.append(np.array([number.setdefault(x, len(number)) for x in coded.dictionary.to_pylist()], dtype=np.int64)[np.asarray(coded.indices)])
            near[ends[0], ends[1]] = near[ends[1], ends[0]] = True
        np.fill_diagonal(near, False)
        names, n = list(number), len(near)
        rank = np.empty(n, dtype=np.int64)
        rank[sorted(range(n), key=names.__getitem__)] = np.arange(n)
        order, gone = near.sum(axis=1) * n + (n - 1 - rank), []  # most relatives first, then the smaller id
        while n and order[worst := int(order.argmax())] >= n:
            order -= near[worst] * n
            order[worst] = -n * n
            gone.append(names[worst])
        yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(gone)) for k in key[: len(keys)]), pa.array(gone, pa.string())], [*keys, "sample"])

    return close.select(*by, "sample1", "sample2", F.col("n").cast("int").alias("n")).groupBy(*by).applyInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "sample string"]))


def first_within_two(close: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample): samples with more relatives, or on ties a smaller id, than all within two steps of them."""
    ends = F.array(F.struct(F.col("sample1").alias("a"), F.col("sample2").alias("b")), F.struct(F.col("sample2").alias("a"), F.col("sample1").alias("b")))
    edges = cut(close.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.a", "e.b"))
    # The order as one value, least first: fewer relatives is larger.
    rank = edges.groupBy(*keys, "a").agg(F.struct((-F.count("*")).alias("count"), F.first("a").alias("id")).alias("rank"))
    least = lambda known: edges.join(known.withColumnRenamed("a", "b"), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("rank").alias("near"))
    one = cut(rank.join(least(rank), [*keys, "a"]).select(*keys, "a", "rank", F.least("rank", "near").alias("one")))
    two = one.join(least(one.select(*keys, "a", F.col("one").alias("rank"))), [*keys, "a"])
    return two.where((F.col("rank") <= F.col("one")) & (F.col("rank") <= F.col("near"))).select(*keys, F.col("a").alias("sample"))


def _dropper(keys: list[str]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set[str]] = {}
        for a, b in zip(frame["sample1"], frame["sample2"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        heap = [(-len(others), s) for s, others in near.items()]
        heapq.heapify(heap)
        gone = []
        while heap:
            count, worst = heapq.heappop(heap)
            if worst not in near or -count != len(near[worst]) or not near[worst]:
                continue  # an earlier drop has changed it
            for other in near.pop(worst):
                near[other].discard(worst)
                heapq.heappush(heap, (-len(near[other]), other))
            gone.append(worst)
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in keys}, "sample": gone})

    return run


def families(close: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample, family) of the samples of ``close`` (keys, sample1, sample2): the family is its smallest sample.

    Each round takes the smallest label of the neighbours and then the label of the label, so chains halve;
    lineage is cut in the shared checkpoint folder.
    """
    edges = cut(close.select(*keys, F.explode(F.array(F.struct(F.col("sample1").alias("a"), F.col("sample2").alias("b")), F.struct(F.col("sample2").alias("a"), F.col("sample1").alias("b")))).alias("e")).select(*keys, "e.a", "e.b").distinct())
    labels = cut(edges.groupBy(*keys, F.col("a").alias("sample")).agg(F.least(F.min("a"), F.min("b")).alias("family")))
    while True:
        reached = edges.join(labels.withColumnRenamed("sample", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("sample")).agg(F.min("family").alias("seen"))
        lower = labels.join(reached, [*keys, "sample"]).select(*keys, "sample", "family", F.least("family", "seen").alias("next"))
        jump = labels.select(*keys, F.col("sample").alias("next"), F.col("family").alias("further"))
        following = cut(lower.join(jump, [*keys, "next"], "left").select(*keys, "sample", F.col("family").alias("before"), F.least("next", F.coalesce("further", "next")).alias("family")))
        if following.where("before <> family").isEmpty():
            return labels
        labels = following.drop("before")


def among(pairs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose ends are both kept; kinship of a pair does not depend on other samples."""
    for end in ("sample1", "sample2"):
        pairs = pairs.join(kept.select(*keys, F.col("sample").alias(end)), [*keys, end], "left_semi")
    return pairs


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, from one scan."""
    others = [x for x in pairs.columns if x not in ("sample1", "sample2")]
    ends = F.array(F.struct(F.col("sample1").alias("a"), F.col("sample2").alias("b")), F.struct(F.col("sample2").alias("a"), F.col("sample1").alias("b")))
    return pairs.select(*others, F.explode(ends).alias("e")).select(*others, F.col("e.a").alias("sample1"), F.col("e.b").alias("sample2"))


def individual_means(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return both_ways(pairs).groupBy(*keys, F.col("sample1").alias("sample")).agg(F.avg("kinship").alias("mean_kinship"))
