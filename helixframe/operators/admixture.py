"""Supervised admixture proportions: the likelihood that expectation-maximisation climbs, in accelerated passes over blocks of sites."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.checkpoints import cut

#: Calls of one block of sites.
BLOCK_CALLS = 2_000_000
#: Bytes of proportions that are sent to all tasks at most; beyond, they are joined to the blocks.
SENT_BYTES = 256 << 20
#: What a block's row holds of a missing call.
NONE = 3
#: Longest extrapolation, in steps.
LONGEST = 64.0


def blocks(genotypes: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, calls): dosage matrices of blocks of sites, a byte a call, samples in the order of ``place``."""
    found = genotypes.join(samples.select(*keys, "sample", "place"), [*keys, "sample"])
    lines = found.groupBy(*keys, "site_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("dosage").cast("int").alias("dosage")))).alias("calls"))
    sizes = samples.groupBy(*keys).agg(F.count("*").cast("int").alias("n_samples"))
    counts = genotypes.select(*keys, "site_id").distinct().groupBy(*keys).count().join(sizes, keys)
    counts = counts.select(*keys, "n_samples", F.ceil(F.col("count") * F.col("n_samples") / BLOCK_CALLS).alias("blocks"))
    dealt = lines.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("site_id"), F.col("blocks")))

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("site_id").combine_chunks()
        lists = group.column("calls").combine_chunks()
        place, dosage = (np.asarray(lists.flatten().field(i)) for i in (0, 1))
        matrix = np.full((group.num_rows, group.column("n_samples")[0].as_py()), NONE, dtype=np.uint8)
        matrix[np.repeat(np.arange(group.num_rows), np.asarray(lists.value_lengths())), place] = dosage
        return pa.Table.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], pa.array([matrix.tobytes()], pa.binary())], [*keys, "block", "calls"])

    schema = T.StructType([*(genotypes.schema[k] for k in keys), T.StructField("block", T.LongType()), T.StructField("calls", T.BinaryType())])
    return dealt.groupBy(*keys, "block").applyInArrow(pack, schema)


def _toward(x: np.ndarray, step: np.ndarray, low: float) -> np.ndarray:
    """x + step, but at most nine tenths of the way to a bound (low, 1 - low) at once."""
    return np.clip(x + step, low + 0.1 * (x - low), 1 - low - 0.1 * (1 - low - x))


def frequencies(alt: np.ndarray, ref: np.ndarray, q: np.ndarray, low: float, rounds: int = 60) -> np.ndarray:
    """(2, sites): the most likely frequencies of both sources, given the samples' proportions, site by site by Newton steps.

    They start at weighted means. A site's likelihood is concave, so there is one maximum, at a bound or inside.
    """
    r, both = 1 - q, np.stack((q, 1 - q))
    p = np.clip(both @ alt.T / np.maximum(both @ (alt + ref).T, 1e-12), low * 2, 1 - low * 2)
    for _ in range(rounds):
        h = np.outer(p[0], q) + np.outer(p[1], r)
        by_alt, by_ref = alt / h, ref / (1 - h)
        slope, bend = by_alt - by_ref, by_alt / h + by_ref / (1 - h)
        ga, ge = slope @ q, slope @ r
        aa, ae, ee = bend @ (q * q) + 1e-9, bend @ (q * r), bend @ (r * r) + 1e-9
        pinned = [((x <= low * 1.01) & (g < 0)) | ((x >= 1 - low * 1.01) & (g > 0)) for x, g in zip(p, (ga, ge))]
        both_free = ~pinned[0] & ~pinned[1]
        det = np.where(both_free, np.maximum(aa * ee - ae * ae, 1e-12 * aa * ee), 1.0)
        step = np.stack((np.where(both_free, (ee * ga - ae * ge) / det, ga / aa), np.where(both_free, (aa * ge - ae * ga) / det, ge / ee)))
        new = np.stack([np.where(held, x, _toward(x, d, low)) for held, x, d in zip(pinned, p, step)])
        moved, p = np.abs(new - p).max(initial=0.0), new
        if moved < 1e-11:
            break
    return p


def sums(g: np.ndarray, q: np.ndarray, low: float) -> tuple[np.ndarray, float]:
    """A block's part of the slope and of the bend of every sample's likelihood (2, samples), and of the log-likelihood."""
    held = g < NONE
    alt, ref = np.where(held, g, 0).astype(float), np.where(held, 2.0 - g.astype(float), 0.0)
    p = frequencies(alt, ref, q, low)
    apart = (p[0] - p[1])[:, None]
    h = np.outer(p[0], q) + np.outer(p[1], 1 - q)
    by_alt, by_ref = alt / h, ref / (1 - h)
    return np.stack((((by_alt - by_ref) * apart).sum(axis=0), ((by_alt / h + by_ref / (1 - h)) * apart**2).sum(axis=0))), float((alt * np.log(h) + ref * np.log(1 - h)).sum())


def _passed(held: DataFrame, state: DataFrame, keys: list[str], low: float, sent: bool) -> DataFrame:
    """(keys, y, likelihood): the proportions that one Newton step leads to from those of ``state`` (x), and the likelihood at x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                q = np.array(row.column("x")[0].as_py())
                both, part = sums(np.frombuffer(row.column("calls")[0].as_py(), dtype=np.uint8).reshape(-1, len(q)), q, low)
                yield pa.RecordBatch.from_arrays([*[row.column(k) for k in keys], *(pa.array([b.tolist()], pa.list_(pa.float64())) for b in both), pa.array([part])], [*keys, "slope", "bend", "part"])

    rows = held.join((F.broadcast(state) if sent else state).select(*keys, "x"), keys).select(*keys, "calls", "x")
    fields = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("slope", "bend")]
    parts = rows.mapInArrow(run, T.StructType([*(held.schema[k] for k in keys), *fields, T.StructField("part", T.DoubleType())]))
    each = parts.select(*keys, "part", F.posexplode(F.arrays_zip("slope", "bend")).alias("place", "s"))
    each = each.groupBy(*keys, "place").agg(F.sum("s.slope").alias("slope"), F.sum("s.bend").alias("bend"), F.sum("part").alias("part"))
    listed = F.array_sort(F.collect_list(F.struct("place", "slope", "bend")))
    found = state.join(each.groupBy(*keys).agg(listed.alias("s"), F.first("part").alias("likelihood")), keys)
    ahead = F.zip_with("x", "s", lambda x, s: F.least(F.greatest(x + s["slope"] / (s["bend"] + 1e-9), x * 0.1), 1 - (1 - x) * 0.1))
    return found.withColumn("y", F.zip_with("fixed", ahead, lambda f, y: F.coalesce(f, y))).drop("s")


def _most(x: str, y: str) -> Column:
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(b - a)))


def _length(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, d: total + d * d))


def _next(state: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """The state after a pass: each key is at the first or the second step of its cycle.

    A first step from an extrapolated point that is less likely than the last second step began is taken back to that
    step's end (``safe``). After a second step the next point is x0 - 2 a r + a² v, with r = x1 - x0 and v = (y - x1) - r.
    """
    second, worse = F.col("second"), F.col("likelihood") < F.col("floor")
    r = F.zip_with("x0", "x", lambda a, b: b - a)
    v = F.zip_with(F.zip_with("x", "y", lambda a, b: b - a), r, lambda s, t: s - t)
    a = F.least(F.greatest(_length(r) / F.greatest(_length(v), F.lit(1e-300)), F.lit(1.0)), F.lit(LONGEST))
    jumped = F.zip_with(F.zip_with("x0", r, lambda x, d: F.struct(x.alias("x"), d.alias("d"))), v, lambda t, w: t["x"] + 2 * a * t["d"] + a * a * w)
    inside = F.zip_with("fixed", jumped, lambda f, x: F.coalesce(f, F.least(F.greatest(x, F.lit(1e-12)), F.lit(1 - 1e-12))))
    moved = F.when(second, F.greatest("moved", _most("x", "y"))).otherwise(_most("x", "y"))
    fallen = ~second & worse
    return state.select(
        *keys, "samples", "fixed",
        F.when(second, inside).when(worse, F.col("safe")).otherwise(F.col("y")).alias("x"), F.when(fallen | second, F.col("x0")).otherwise(F.col("x")).alias("x0"),
        F.when(second, F.col("y")).otherwise(F.col("safe")).alias("safe"), F.when(second, F.col("likelihood")).when(worse, F.lit(-math.inf)).otherwise(F.col("floor")).alias("floor"),
        (~second & ~worse).alias("second"), moved.alias("moved"), (second & (moved <= tolerance)).alias("ended"),
    )


def supervised(genotypes: DataFrame, labels: DataFrame, iterations: int = 200, low: float = 1e-5, tolerance: float = 1e-4, keys: list[str] = []) -> DataFrame:
    """(keys, sample, afr_q, eur_q, moved, converged) for two sources.

    ``genotypes`` has sample, site_id and dosage (0 to 2); ``labels`` has sample and label, where AFR
    and EUR samples keep their source and others are free; both have ``keys`` (a replicate), which are fitted apart.
    Calls without a row are missing.

    Sites are dealt into blocks of dosages once. A pass over the blocks sends all proportions (size checked) to them: a
    block finds its sites' most likely frequencies by itself, and its part of the slope and bend of each sample's
    likelihood; their sums give the proportions' next step. Two steps and a squared extrapolation from them are a
    cycle. A replicate ends when neither step of a cycle moves a proportion by more than ``tolerance``; others go on, to
    ``iterations`` passes at most. ``moved`` is its largest last move, ``converged`` whether that is within the tolerance.
    """
    given, keys = keys, keys or ["_fit"]
    if not given:
        genotypes, labels = (df.withColumn("_fit", F.lit(0)) for df in (genotypes, labels))
    fixed = F.when(F.col("label") == "AFR", 1.0).when(F.col("label") == "EUR", 0.0).alias("fixed")
    known = labels.join(genotypes.select(*keys, "sample").distinct(), [*keys, "sample"], "left_semi").select(*keys, "sample", fixed).distinct()
    samples = cut(known.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("sample")) - 1))
    held = cut(blocks(genotypes, samples, keys))
    listed = F.array_sort(F.collect_list(F.struct("place", "sample", "fixed")))
    state = samples.groupBy(*keys).agg(F.transform(listed, lambda s: s["sample"]).alias("samples"), F.transform(listed, lambda s: s["fixed"]).alias("fixed"))
    start = F.transform("fixed", lambda f: F.coalesce(f, F.lit(0.5)))
    state = cut(state.select("*", *[start.alias(c) for c in ("x", "x0", "safe")], F.lit(-math.inf).alias("floor"), F.lit(False).alias("second"), F.lit(math.inf).alias("moved"), F.lit(False).alias("ended")))
    sent = 8 * samples.count() <= SENT_BYTES
    done = []
    for number in range(iterations):
        state = cut(_next(_passed(held, state, keys, low, sent), keys, tolerance))
        last = number == iterations - 1
        done.append(state.where(F.col("ended") | F.lit(last)).select(*keys, "samples", F.when(F.col("ended"), F.col("safe")).otherwise(F.col("x")).alias("q"), "moved", "ended"))
        state = state.where(~F.col("ended"))
        if last or state.isEmpty():
            break
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    out = rows.select(*keys, F.explode(F.arrays_zip("samples", "q")).alias("s"), "moved", "ended")
    return out.select(*given, F.col("s.samples").alias("sample"), F.col("s.q").alias("afr_q"), (1 - F.col("s.q")).alias("eur_q"), "moved", F.col("ended").alias("converged"))
