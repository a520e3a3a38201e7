"""Linkage-disequilibrium decay in genome windows, its aggregation, and pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import divide, folded
from ..sources.checkpoints import cut
from . import packed
from .genotype import SITE, UNIT

WINDOW_BP, BIN_BP, MAF = 2_000_000, 5_000, 0.10
#: Sites of one side of a block of pairs.
BLOCK = 512
#: Windows of one block that share a group.
WINDOWS_PER_GROUP = 16


def wide(calls: DataFrame, maf: float | None = None) -> DataFrame:
    """One row for each site and population: individuals, their dosages in the same order, and calls of allele 1.

    With ``maf``, only sites whose minor-allele frequency, pooled over populations and from allele 1 alone, reaches it.
    Calls are dealt by site once; dosages, arrays and pooled frequencies are made where they then are.
    """
    each = calls.repartition(*SITE).groupBy(*SITE, "pop", "ind").agg(
        F.sum((F.col("allele") > 0).cast("int")).cast("int").alias("dosage"), F.count(F.when(F.col("allele") >= 0, 1)).alias("n_called"), F.count(F.when(F.col("allele") == 1, 1)).alias("n_alt")
    )
    rows = each.groupBy(*SITE, "pop").agg(F.array_sort(F.collect_list(F.struct("ind", "dosage"))).alias("d"), F.sum("n_called").alias("n_called"), F.sum("n_alt").alias("n_alt"))
    if maf is not None:
        site = W.partitionBy(*SITE)  # one row for each population
        rows = rows.withColumn("maf", folded(F.sum("n_alt").over(site) / F.sum("n_called").over(site))).where(F.col("maf") >= maf)
    return rows.select(*SITE, "pop", F.transform("d", lambda x: x["ind"]).alias("inds"), F.transform("d", lambda x: x["dosage"]).alias("dosage"))


BINS = "rep int, chrom string, pop string, window_start long, distance_bin_bp long, sum_r2 double, n_pairs long, n_valid long"


def _pair_bins(left: pa.Table, right: pa.Table | None, window_bp: int, bin_bp: int) -> list[np.ndarray]:
    """(bins, summed r2, pairs, pairs that vary) of the pairs between two blocks of sites, or within one."""
    rows = left if right is None else pa.concat_tables([left, right])
    coded, n = packed.codes(rows.column("codes")), left.num_rows
    _, g, held = packed.matrix(coded)
    position = rows.column("position").to_numpy()
    a, b = slice(0, n), slice(0, n) if right is None else slice(n, None)
    distance = np.abs(position[b][None, :] - position[a][:, None])
    valid = (distance > 0) & (distance <= window_bp)
    if right is None:
        valid = np.triu(valid, k=1)
    r2 = packed.squared_correlations(g[a], held[a], g[b], held[b])[valid]
    place, fine = (distance[valid].astype(np.int64) - 1) // bin_bp, np.isfinite(r2)
    pairs = np.bincount(place)
    used = np.flatnonzero(pairs)
    return [used, *(np.bincount(place, weights=w, minlength=len(pairs))[used] for w in (np.where(fine, r2, 0), None, fine))]


def dealt_tiles(sites: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``sites`` dealt to tiles: the rows of equal ``keys`` are hashed into blocks of about ``block`` sites, and each pair of
    blocks (i <= j) is a tile; ``side`` tells its two blocks apart and ``blocks`` how many there are.
    """
    sizes = sites.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("site_id", "position"), F.col("blocks")).cast("int")
    rows = sites.join(sizes, keys).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other")


def decay(calls: DataFrame, spans: DataFrame, window_bp: int = WINDOW_BP, bin_bp: int = BIN_BP, maf: float = MAF) -> DataFrame:
    """Mean and sum of r2 and the pair counts in each distance bin of each window.

    Sites are packed, two bits a call. A window of many sites is cut into tiles, pairs between two of its blocks of
    about BLOCK sites, each a group of its own; neighbouring windows of one block share a group. Only distance bins
    leave a task, never pairs, and add up over tiles. Pairs with a site that does not vary count in n_pairs alone.
    """
    sites = packed.sites(calls)
    if maf > 0:
        site = W.partitionBy(*SITE)  # one row for each population
        sites = sites.withColumn("maf", folded(F.sum("n_alt").over(site) / F.sum("n_called").over(site))).where(F.col("maf") >= maf)
    keys = [*UNIT, "pop", "window_start"]
    placed = sites.withColumn("window_start", (F.floor(F.col("position") / window_bp) * window_bp).cast("long")).select(*keys, "site_id", "position", "codes")
    dealt = dealt_tiles(cut(placed), keys, BLOCK)  # packed rows are counted and dealt; the calls are read once
    several = F.col("blocks") > 1
    place = F.when(several, F.col("window_start")).otherwise(F.floor(F.col("window_start") / (window_bp * WINDOWS_PER_GROUP)).cast("long")).alias("place")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        found: list[list] = [[] for _ in range(8)]
        for tile in packed.tiles(group, [*keys, "i", "j"]):
            side = tile.column("side").to_numpy()
            one, two = tile.filter(pa.array(side == 0)), tile.filter(pa.array(side == 1))
            same = tile.column("i")[0] == tile.column("j")[0]
            if not one.num_rows or not (same or two.num_rows):
                continue
            used, *sums = _pair_bins(one, None if same else two, window_bp, bin_bp)
            for column, value in zip(found, [*([tile.column(k)[0].as_py()] * len(used) for k in keys), (used + 1) * bin_bp, *sums]):
                column.extend(value)
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], [f.split()[0] for f in BINS.split(", ")])

    groups = dealt.groupBy(*UNIT, F.when(several, F.col("pop")).alias("apart"), place, "i", "j")
    binned = groups.applyInArrow(run, BINS).groupBy(*keys, "distance_bin_bp").agg(*[F.sum(c).alias(c) for c in ("sum_r2", "n_pairs", "n_valid")])
    end = F.least(F.col("window_start") + window_bp, F.col("span")).cast("long")
    return binned.join(spans, UNIT).select(*UNIT, "pop", "window_start", end.alias("window_end"), "distance_bin_bp", divide("sum_r2", "n_valid").alias("mean_r2"), "sum_r2", "n_pairs", "n_valid")


def reaggregate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over finer rows: mean r2 is the summed r2 over all pairs."""
    sums = rows.groupBy(*keys).agg(F.sum("sum_r2").alias("sum_r2"), F.sum("n_pairs").alias("n_pairs"))
    return sums.withColumn("mean_r2", divide("sum_r2", "n_pairs"))


def _correlated(frame: pd.DataFrame, r2: float) -> pd.DataFrame:
    """Pairs of sites above the threshold, among those that start in this block."""
    frame = frame.sort_values("place")
    g = np.array(frame["dosage"].tolist(), dtype=np.float64)
    total, n = g.sum(axis=1), g.shape[1]
    variance = n * (g * g).sum(axis=1) - total**2
    with np.errstate(divide="ignore", invalid="ignore"):
        square = (n * (g @ g.T) - np.outer(total, total)) ** 2 / np.outer(variance, variance)
    i, j = np.nonzero(np.triu(square > r2, k=1))  # flat sites compare false
    own, place = frame["own"].to_numpy(), frame["place"].to_numpy()
    keep = own[i]
    first = frame.iloc[0]
    return pd.DataFrame({"rep": first["rep"], "chrom": first["chrom"], "a": place[i[keep]], "b": place[j[keep]]})


def _swept(row: dict, block: int, window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sites of a block stay, and which of the window behind it are left so far, given which of its first ones earlier blocks left."""
    minor, near = row["minor"], row["near"]
    alive = np.ones(max(len(minor), block + window), dtype=bool)
    alive[:window] = np.frombuffer(row["frontier"], dtype=bool)
    for at in range(0, block, step):
        for i in range(at, min(at + window, len(minor))):
            for j in near[i] or ():
                if not alive[i]:
                    break
                if j < at + window and alive[j]:
                    alive[i if minor[i] < minor[j] else j] = False
    return alive[: min(block, row["own"])], alive[block : block + window]


def _sweep(blocks: DataFrame, frontier: DataFrame, block: int, window: int, step: int) -> DataFrame:
    """(rep, chrom, block, kept, ahead): the sites that each block keeps, and the frontier of the one behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                alive, ahead = _swept(row, block, window, step)
                kept = [{"site_id": s, "position": p} for s, p, a in zip(row["site_id"], row["position"], alive.tolist()) if a]
                kind = pa.list_(pa.struct([("site_id", pa.int32()), ("position", pa.float64())]))
                yield pa.RecordBatch.from_arrays([pa.array([row["rep"]], pa.int32()), pa.array([row["chrom"]]), pa.array([row["block"]], pa.int64()), pa.array([kept], kind), pa.array([ahead.tobytes()], pa.binary())], ["rep", "chrom", "block", "kept", "ahead"])

    return blocks.join(frontier, [*UNIT, "block"]).mapInArrow(run, "rep int, chrom string, block long, kept array<struct<site_id:int,position:double>>, ahead binary")


def prune(sites: DataFrame, window: int = 50, step: int = 10, r2: float = 0.1) -> DataFrame:
    """Sites (rep, chrom, site_id, position) left by sliding-window pruning of each chromosome: of a pair above the threshold
    the one with the lower minor-allele frequency goes, on ties the later one.

    ``sites`` has one row for each site, with the dosages of all samples in one order. Correlations are made in blocks
    of sites, each with the window that follows it, in tasks of their own. What a window drops depends on earlier
    windows, but only on what they left of its own sites: a block is swept from its frontier, the sites of its first window that the
    block before it left. All blocks are swept at once, from frontiers as they are known, and swept again while any frontier
    changes; a block's is right once that of the one before is, so what no longer changes is the one pass in order. Few
    rounds are needed, as what is dropped seldom matters a window further. Only the numbering of sites by
    position, a few numbers each, is one window for each chromosome.
    """
    sites = cut(sites)  # numbered, correlated and swept
    x = F.transform("dosage", lambda v: v.cast("double"))
    p = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / (2 * F.size("dosage"))
    block = -(-max(BLOCK, window) // step) * step
    placed = sites.select(*UNIT, "site_id", "position").withColumn("place", (F.row_number().over(W.partitionBy(*UNIT).orderBy("position", "site_id")) - 1).cast("long"))
    numbered = sites.withColumn("minor", folded(p)).join(placed, [*UNIT, "site_id", "position"])
    own = F.expr(f"place DIV {block}")
    # A site belongs to its block and, within a window of its start, to the one before.
    copies = F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), F.struct((own - 1).alias("block"), F.lit(False).alias("own")))
    near = F.filter(copies, lambda c: c["own"] | ((c["block"] >= 0) & (F.col("place") - own * block < window)))
    dealt = numbered.select(*UNIT, "place", "dosage", F.explode(near).alias("c")).select(*UNIT, "place", "dosage", "c.block", "c.own")
    pairs = dealt.groupBy(*UNIT, "block").applyInPandas(lambda f: _correlated(f, r2), "rep int, chrom string, a long, b long").where(F.col("b") - F.col("a") < window)
    listed = pairs.groupBy(*UNIT, F.col("a").alias("place")).agg(F.sort_array(F.collect_list("b")).alias("near"))
    rows = numbered.drop("dosage").join(listed, [*UNIT, "place"], "left").select(*UNIT, "place", "site_id", "position", "minor", "near", F.explode(near).alias("c"))
    local = rows.select(*UNIT, "c.block", F.struct((F.col("place") - F.col("c.block") * block).alias("place"), "site_id", "position", "minor", F.transform("near", lambda j: j - F.col("c.block") * block).alias("near"), F.col("c.own").alias("own")).alias("s"))
    held = local.groupBy(*UNIT, "block").agg(F.array_sort(F.collect_list("s")).alias("s"))
    names = ["site_id", "position", "minor", "near"]
    blocks = cut(held.select(*UNIT, "block", *[F.col(f"s.{n}").alias(n) for n in names], F.size(F.filter("s", lambda s: s["own"])).alias("own")))
    none = F.lit(bytearray(b"\x01" * window))
    frontier = cut(blocks.select(*UNIT, "block", none.alias("frontier")))
    while True:
        swept = cut(_sweep(blocks, frontier, block, window, step))
        ahead = swept.select(*UNIT, (F.col("block") + 1).alias("block"), "ahead")
        following = cut(frontier.join(ahead, [*UNIT, "block"], "left").select(*UNIT, "block", F.col("frontier").alias("before"), F.coalesce("ahead", none).alias("frontier")))
        if following.where("before <> frontier").isEmpty():
            return swept.select(*UNIT, F.explode("kept").alias("k")).select(*UNIT, "k.site_id", "k.position")
        frontier = following.drop("before")
