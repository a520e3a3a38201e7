"""Near-duplicate classes by SetSketch registers: banded, estimated jointly by likelihood, then verified.

1. A sketch has REGISTERS registers. Every n-gram has an exponentially distributed value for each of them, made as an
   ascending series with exponential spacings that ends as soon as no register can be lowered; a register holds the
   smallest value over the set, as the truncated integer floor(1 - log_BASE(value)) in 0 to TOP. So sketches of
   parts of a set merge by the larger register (``merged``), and registers of similar sets are equal with a chance
   of about their Jaccard similarity.
2. BANDS bands of ROWS registers each are hashed; sets with an equal band are candidates. A pair at similarity s has no
   equal band with a chance of (1 - s ** ROWS) ** BANDS: 2e-9 at 0.85, less above. Equal sets share one node
   first. Map chunks and key ranges of a band pass on forests, not all pairs, so a band gives each node one edge at most.
3. Candidate components are dealt into chunks as in the n-gram join. In a chunk, one sketch after another is
   compared with all that are not yet in its component: numbers of registers that are larger, smaller and equal
   give the likelihood of each similarity for two sets of known sizes. Pairs for which the threshold is over
   DOUBT log-units less likely than the best estimate are left (a linked pair: about once in 10 ** 9); all others are
   verified on the full sets of hashes.

Defined cases: as for ``jaccard.classes``: empty sets link with nothing; a short text's words are its one n-gram; rows of
one id are one document; a null id has a null class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, jaccard
from .common import materialize, mix
from .graph import components, hooked

REGISTERS = 256
#: Values of a register are 0 to TOP, spaced by BASE; RATE is that of the exponential values.
BASE, TOP, RATE = 1.001, (1 << 16) - 2, 20.0
BANDS, ROWS = 42, 6
#: Log-units by which the threshold may be less likely than the best estimate.
DOUBT = 20.0
#: Keys of one key range of a band.
KEYS_PER_RANGE = 1_000_000
_STEP, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def minima(holder: np.ndarray, grams: np.ndarray, n_sets: int) -> np.ndarray:
    """(n_sets, REGISTERS): the smallest exponential value of each register over each set's n-grams; infinite in empty sets.

    The j-th smallest of an n-gram's REGISTERS values is the one before plus an exponential spacing; it belongs to the
    j-th register of the n-gram's own order of them. What is beyond a set's largest minimum changes nothing, and so ends the series.
    """
    least = np.full(n_sets * REGISTERS, np.inf)
    hashed = mix(grams ^ np.uint64(0x2545F4914F6CDD1D))
    start, stride = hashed & np.uint64(REGISTERS - 1), (hashed >> np.uint64(20)) | np.uint64(1)
    owner, value = holder, np.zeros(len(grams))
    for j in range(REGISTERS if len(grams) else 0):
        draw = mix(hashed + np.uint64((j + 1) * _STEP & _ALL)) >> np.uint64(11)
        value = value - np.log((draw.astype(np.float64) + 0.5) * 2.0**-53) / (RATE * (REGISTERS - j))
        register = (start + np.uint64(j) * stride) & np.uint64(REGISTERS - 1)
        np.minimum.at(least, owner * REGISTERS + register.astype(np.int64), value)
        some = owner[np.concatenate(([True], owner[1:] != owner[:-1]))]  # owners ascend
        limit = np.full(n_sets, -np.inf)
        limit[some] = least.reshape(n_sets, REGISTERS)[some].max(axis=1)
        alive = value < limit[owner]
        if not alive.any():
            break
        owner, value, hashed, start, stride = (x[alive] for x in (owner, value, hashed, start, stride))
    return least.reshape(n_sets, REGISTERS)


def registers(holder: np.ndarray, grams: np.ndarray, n_sets: int) -> np.ndarray:
    """The sketches of sets, given as (owner, n-gram): truncated exponents of the minima, 0 in empty sets."""
    least = minima(holder, grams, n_sets)
    with np.errstate(divide="ignore"):
        exponent = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(exponent, 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(sets, BANDS): a hash of each band's registers."""
    used = sketches[:, : BANDS * ROWS].reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(sketches), BANDS), dtype=np.uint64)
    for row in range(ROWS):
        key = mix(key * np.uint64(_STEP) + used[:, :, row] + np.uint64(1))
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def _larger(x: np.ndarray) -> np.ndarray:
    """The chance that one register exceeds the other if a share x of the union is in its set alone."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(j: np.ndarray, share: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarity j for sets of which the first has ``share`` of both sizes, given the registers' comparison."""
    up, down = _larger(share - (1 - share) * j), _larger(1 - share - share * j)
    tiny = 1e-300
    return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))


def joint_estimate(sizes_a: np.ndarray, sizes_b: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The most likely similarity: the likelihood is concave, so its maximum is narrowed by golden sections."""
    share = sizes_a / (sizes_a + sizes_b)
    low, high = np.zeros(len(share)), np.minimum(sizes_a, sizes_b) / np.maximum(sizes_a, sizes_b)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(a, share, more, less, same) >= likelihood(b, share, more, less, same)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def least_equal(threshold: float) -> int:
    """Fewer equal registers than this are over DOUBT log-units less likely at the threshold than at their own share."""
    chance = 1 - 2 * float(_larger(np.array((1 - threshold) / 2)))  # of one register, for sets of one size; more for others
    share = np.arange(1, REGISTERS) / REGISTERS
    lost = REGISTERS * (share * np.log(share / chance) + (1 - share) * np.log((1 - share) / (1 - chance)))
    return int(np.flatnonzero((lost <= DOUBT) | (share >= chance))[0]) + 1


def likely(sketch: np.ndarray, size: int, sketches: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The places of sketches that may have 'den * both >= num * either' with this one."""
    fits = np.flatnonzero(den * np.minimum(sizes, size) >= num * np.maximum(sizes, size))
    same = (sketches[fits] == sketch).sum(axis=1)
    near = same >= least_equal(num / den)
    fits, same = fits[near], same[near]
    n, own = sizes[fits].astype(float), np.full(len(fits), float(size))
    less = (sketch < sketches[fits]).sum(axis=1)
    more = REGISTERS - same - less
    best, share = joint_estimate(own, n, more, less, same), own / (own + n)
    doubt = likelihood(best, share, more, less, same) - likelihood(np.full(len(fits), num / den), share, more, less, same)
    return fits[(best >= num / den) | (doubt <= DOUBT)]


def sketch_links(nodes: np.ndarray, sets: list[np.ndarray], num: int, den: int, asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the same components as all links: among all sets, or of each asking set with all.

    Sets are sorted arrays of hashes. One set after another is compared with those outside its component that have not
    been compared themselves, until all others lie in one component.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    sketches = registers(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), len(sets))
    root, asked, links = np.arange(len(sets)), np.zeros(len(sets), dtype=bool), []
    queue = np.flatnonzero(asking).tolist() if asking is not None else []
    while True:
        if asking is None:
            queue = np.flatnonzero(~asked & (root != np.bincount(root).argmax()))[:1].tolist()
        if not queue:
            return links
        q = queue.pop()
        asked[q] = True
        others = np.flatnonzero((root != root[q]) & ~asked)
        for i in others[likely(sketches[q], int(sizes[q]), sketches[others], sizes[others], num, den)].tolist():
            if root[i] != root[q]:
                place = np.minimum(np.searchsorted(sets[q], sets[i]), len(sets[q]) - 1)
                if (num + den) * int((sets[q][place] == sets[i]).sum()) >= num * int(sizes[q] + sizes[i]):
                    links.append((int(nodes[q]), int(nodes[i])))
                    root[root == root[i]] = root[q]


# ---------------------------------------------------------------- Spark


def _scan(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(id, n_shingles, node) of every document."""

    def make(ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        holder, grams, sizes = jaccard.sets_of(texts, n)
        columns = [pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(jaccard.nodes_of(holder, grams, sizes))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "node"])

    return jaccard.each_chunk(docs, doc_id, text, make, "id long, n_shingles long, node long")


def candidates(docs: DataFrame, nodes: int, doc_id: str, text: str, n: int) -> DataFrame:
    """(a, b): nodes that share a band with others, each with one of those."""
    ranges = 1 + nodes // KEYS_PER_RANGE

    def make(ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        holder, grams, sizes = jaccard.sets_of(texts, n)
        found, first = np.unique(jaccard.nodes_of(holder, grams, sizes), return_index=True)
        first, found = first[sizes[first] > 0], found[sizes[first] > 0]
        if not len(first):
            return
        place = np.full(len(sizes), -1, dtype=np.int64)
        place[first] = np.arange(len(first))
        own = place[holder] >= 0
        keys = band_keys(registers(place[holder][own], grams[own], len(first)))
        for band in range(BANDS):
            yield from exchange.rows(keys[:, band], found, ranges, band * ranges, hooked)

    def star(key: tuple, group: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(x) for x in hooked(*exchange.links(group))], ["a", "b"])

    return jaccard.each_chunk(docs, doc_id, text, make, exchange.PAIRS).groupBy("bucket").applyInArrow(star, "a long, b long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row: texts link when den * intersection >= num * union."""
    members = materialize(_scan(docs, doc_id, text, n))
    holders = members.where("n_shingles > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("size"))
    near = components(candidates(docs, holders.count(), doc_id, text, n))
    dealt = jaccard.dealt_out(holders.select("id", "node", "size").join(near.toDF("node", "comp"), "node"))
    found = jaccard.links(docs, dealt, doc_id, text, n, num, den, sketch_links)
    return jaccard.labelled(members, found, doc_id)
