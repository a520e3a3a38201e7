"""N-gram Jaccard join by prefix trees, exact, with one class for each component of links.

1. Every document's set of word n-grams is hashed to 64-bit values; equal sets share one node, the
   hash of the set, so copies collapse before anything is moved.
2. Candidate nodes: two linked sets of sizes a and b differ in at most
   d = (den - num)(a + b) / (den + num) n-grams. The hash space is cut into m > d segments (as many
   for all sets of a size band), of which at most d differ. So the d + 1 first segments of each, in
   one order for all, have one in common: each node sends those as keys, segments with many
   infrequent n-grams first, in both of its bands. Equal keys make candidates: map chunks and the key
   ranges of a band pass on forests of them, not all pairs, and candidate components follow for each
   band. Frequent lines or passages alone fill few segments that are sent; the order is a matter of
   cost only. It comes from a sketch of SKETCH counters that every n-gram of every document updates.
3. The sets of a candidate component, each moved once, are stored in a trie in their global order
   (frequent n-grams first) and traversed by one set after another: all sets below a node share the
   partial overlap, and subtrees that cannot reach the needed overlap with what is left of either
   set are pruned. The overlap at a leaf is exact. Pairs that are already connected are not needed:
   sets are traversed until all others lie in one component.
4. Components beyond CHUNK_SETS are dealt into chunks. Chunks are joined by themselves, then what
   stands for their components, and then every set outside the largest component with all others,
   block by block. So no link is lost, and a group of copies costs about its size.

Defined cases: null and empty texts, and texts without words, have empty sets and link with
nothing. A text shorter than an n-gram has its whole word sequence as its one n-gram. Rows with a
null id keep a null class. Repeated ids count as one document with the links of each row. Ties do
not arise: classes are the smallest ids. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import mix, materialize, text_chunks, window_hashes, word_hashes
from .graph import components, hooked

#: Segments for each four that a set sends.
MORE_SEGMENTS = 5
#: Counters of the sketch; an n-gram is frequent if its counter has over FREQUENT times the mean, and 2 at least.
SKETCH, FREQUENT = 1 << 20, 2
#: Counters that one row of a task's sketch holds.
SKETCH_PART = 1 << 16
#: Segment keys of one key range of a band.
KEYS_PER_RANGE = 2_000_000
#: Sets, and n-grams, that one trie holds on average.
CHUNK_SETS, CHUNK_GRAMS = 2048, 2_000_000
#: Ids of documents without one start here, beyond usual ids.
UNNAMED = 1 << 62
#: So many large components, or nodes of many rows, are sent to all tasks at most (16 bytes each).
FEW = 100_000
#: A node that more rows hold is joined back to them in shares of about so many.
HOT_ROWS = 10_000
#: Bits of a filter of ids for each of them, of one part of it, and of all at most (16 MB): a full one lets more rows through, never fewer.
FILTER_BITS, FILTER_PART, FILTER_MOST = 16, 1 << 19, 1 << 27
#: Longest edge of a trie before bounds are tested again.
EDGE = 32


def sets_of(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram) of each text's distinct n-grams, sorted, and each text's set size."""
    words, owner = word_hashes(texts)
    grams, first = window_hashes(words, owner, n)
    holder = owner[first] if len(first) else np.zeros(0, dtype=np.int64)
    count = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence is the one n-gram; its length keeps it apart from others
        begin = np.searchsorted(owner, short)
        whole = np.array([_sequence(words[b : b + c]) for b, c in zip(begin, count[short])], dtype=np.uint64)
        grams, holder = np.concatenate((grams, whole)), np.concatenate((holder, short))
    order = np.lexsort((grams, holder))
    grams, holder = grams[order], holder[order]
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (holder[1:] != holder[:-1]))) if len(grams) else np.zeros(0, dtype=bool)
    return holder[new], grams[new], np.bincount(holder[new], minlength=len(texts))


def _sequence(words: np.ndarray) -> np.uint64:
    total = np.array([len(words)], dtype=np.uint64)
    for w in words:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + w)
    return total[0]


def nodes_of(holder: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The node of each set: a hash of its sorted n-grams (the empty set's is not used)."""
    place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = np.zeros(len(sizes), dtype=np.uint64)
    np.add.at(total, holder, mix(grams + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)))
    return mix(total + sizes.astype(np.uint64)).view(np.int64)


def bands_of(sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The two size bands of each set: band i holds the classes i and i + 1, and linked sets share a band."""
    step = np.log(den / num) + 1e-6
    own = np.floor(np.log(np.maximum(sizes, 1)) / step).astype(np.int64)
    return own, own - 1


def in_band(nodes: np.ndarray, band: np.ndarray) -> np.ndarray:
    """A node's id among the candidates of one band."""
    return mix(nodes.view(np.uint64) ^ mix(band.astype(np.uint64) + np.uint64(0x51ED270B))).view(np.int64)


def most_differing(band: np.ndarray, num: int, den: int) -> np.ndarray:
    """In how many n-grams two linked sets of a band can differ."""
    largest = np.floor(np.exp((band + 2) * (np.log(den / num) + 1e-6))).astype(np.int64) + 1
    return (den - num) * 2 * largest // (den + num)


def counter_of(grams: np.ndarray) -> np.ndarray:
    """Each n-gram's counter in the sketch."""
    return (grams >> np.uint64(32)).astype(np.int64) % SKETCH


def segment_keys(holder: np.ndarray, grams: np.ndarray, sizes: np.ndarray, num: int, den: int, frequent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, set, band) of the segments that each set sends, for each of its two bands.

    Of m segments at most d differ, so the d + 1 first in any order of segments that both sets
    follow have one in common; the order puts segments with many infrequent n-grams first.
    """
    rare = ~frequent[counter_of(grams)]
    found = []
    for band in bands_of(sizes, num, den):
        differing = most_differing(band, num, den)
        used = (sizes > 0) & (band >= 0) & (differing > 0)
        m = np.where(used, (differing + 1) * MORE_SEGMENTS // 4, 0)
        base = np.cumsum(m) - m
        use = m[holder] > 0
        h, g, r = holder[use], grams[use], rare[use]
        segment = ((mix(g ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * m[h].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot = base[h] + segment
        content = np.zeros(int(m.sum()), dtype=np.uint64)
        order = np.argsort(slot, kind="stable")
        slot, g, r = slot[order], g[order], r[order]
        if len(slot):
            first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            content[slot[first]] = np.add.reduceat(mix(g), first)
        weight = np.bincount(slot, weights=r, minlength=len(content)).astype(np.int64)
        of = np.repeat(np.arange(len(sizes)), m)
        number = np.arange(len(content)) - base[of]
        key = mix(content + mix((band[of].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64)))
        ranked = np.lexsort((key, -weight, of))
        sent = ranked[number <= differing[of]]  # ranked by set: places 0 to d of each
        found.append((key[sent], of[sent], band[of[sent]]))
    return found


# ---------------------------------------------------------------- the trie


class Trie:
    """Sets of ranks (ascending) as a prefix tree in arrays; nodes are numbered parents first."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        ordered = [sets[i] for i in order]
        sizes = [len(s) for s in ordered]
        shared = [0] * (len(sets) + 1)
        for i in range(1, len(sets)):
            a, b = ordered[i - 1], ordered[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared[i] = int(differ[0]) if len(differ) else n
        parent, begin, end, source, low, high, leaf = [-1], [0], [0], [0], [0], [0], [-1]
        path = [0]  # nodes from the root to the last set's leaf

        def grow(at: int, stop: int, i: int) -> None:
            while at < stop:
                upto = min(at + EDGE, stop)
                parent.append(path[-1])
                begin.append(at)
                end.append(upto)
                source.append(i)
                leaf.append(-1)
                path.append(len(parent) - 1)
                at = upto

        for i in range(len(ordered)):
            depth = shared[i]
            while end[path[-1]] > depth and begin[path[-1]] >= depth:
                path.pop()
            if end[path[-1]] > depth:  # the last set's edge is split where the two part
                node = path.pop()
                parent.append(parent[node])
                begin.append(begin[node])
                end.append(depth)
                source.append(source[node])
                leaf.append(-1)
                middle = len(parent) - 1
                parent[node], begin[node] = middle, depth
                path.append(middle)
            grow(depth, sizes[i], i)
            parent.append(path[-1])  # where the set ends
            begin.append(sizes[i])
            end.append(sizes[i])
            source.append(i)
            leaf.append(order[i])
        self.begin, self.end, self.leaf = np.array(begin), np.array(end), np.array(leaf)
        source_of = np.array(source)
        up = np.array(parent)
        n = len(up)
        depth_of = np.zeros(n, dtype=np.int64)
        todo = up.copy()
        while (todo >= 0).any():
            depth_of[todo >= 0] += 1
            todo = np.where(todo >= 0, up[np.maximum(todo, 0)], -1)
        size_of = np.array(sizes)[source_of]
        low, high = np.full(n, 1 << 40), np.zeros(n, dtype=np.int64)
        ends = self.leaf >= 0
        low[ends] = high[ends] = size_of[ends]
        for d in range(int(depth_of.max()), 0, -1):
            here = np.flatnonzero(depth_of == d)
            np.minimum.at(low, up[here], low[here])
            np.maximum.at(high, up[here], high[here])
        self.low, self.high = low, high
        by = np.argsort(up, kind="stable")
        self.children = by
        self.first_child = np.searchsorted(up[by], np.arange(n + 1))
        length = self.end - self.begin
        flat = [ordered[s][b:e] for s, b, e in zip(source, begin, end)]
        self.tokens = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(length)))
        self.last = np.where(self.end > 0, np.array([int(ordered[s][e - 1]) if e > 0 else -1 for s, e in zip(source, end)]), -1)

    def overlaps(self, x: np.ndarray, mark: np.ndarray, num: int, den: int) -> np.ndarray:
        """The sets whose overlap with x (marked in ``mark``) makes 'den * both >= num * either'."""
        frontier, both, found, size = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), [], len(x)
        while len(frontier):
            n = self.first_child[frontier + 1] - self.first_child[frontier]
            kids = self.children[np.repeat(self.first_child[frontier] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            shared = np.repeat(both, n)
            reach = np.minimum(shared + self.high[kids] - self.begin[kids], size)
            near = ((num + den) * reach >= num * (size + self.low[kids])) & ((num + den) * (shared + self.high[kids] - self.begin[kids]) >= num * (size + self.high[kids]))
            kids, shared = kids[near], shared[near]
            length = self.at[kids + 1] - self.at[kids]
            if total := int(length.sum()):
                hits = mark[self.tokens[np.repeat(self.at[kids] - np.cumsum(length) + length, length) + np.arange(total)]]
                shared = shared + np.bincount(np.repeat(np.arange(len(kids)), length), weights=hits, minlength=len(kids)).astype(np.int64)
            done = self.leaf[kids] >= 0
            fits = done & ((num + den) * shared >= num * (size + self.low[kids]))
            found.append(self.leaf[kids[fits]])
            passed = np.searchsorted(x, self.last[kids], side="right")
            most_here = shared + self.high[kids] - self.end[kids]  # all that is left of the longest set below
            most_x = shared + size - passed  # all that is left of x
            alive = ~done & ((num + den) * most_here >= num * (size + self.high[kids])) & ((num + den) * most_x >= num * (size + self.low[kids]))
            frontier, both = kids[alive], shared[alive]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Sets as ascending ranks: frequent n-grams first, ties by hash."""
    grams, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), dtype=np.int64)
    rank[np.lexsort((grams, -counts))] = np.arange(len(grams))
    ranked, out, at = rank[inverse], [], 0
    for s in sets:
        out.append(np.sort(ranked[at : at + len(s)]))
        at += len(s)
    return out, len(grams)


def trie_links(nodes: np.ndarray, sets: list[np.ndarray], num: int, den: int, asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the same components as all links: among all sets, or of each asking set with all."""
    ranked, n_grams = _ranked(sets)
    trie, mark = Trie(ranked), np.zeros(n_grams, dtype=np.int64)
    root = np.arange(len(sets))  # labels of components, relabelled on each merge
    asked = np.zeros(len(sets), dtype=bool)
    links: list[tuple[int, int]] = []
    queue = list(np.flatnonzero(asking)) if asking is not None else []
    while True:
        if asking is not None:
            if not queue:
                return links
            q = queue.pop()
        else:
            sizes = np.bincount(root, minlength=len(sets))
            waiting = np.flatnonzero(~asked & (root != sizes.argmax()))
            if not len(waiting):
                if asked.any() or len(sets) < 2:
                    return links
                waiting = np.flatnonzero(~asked)
            q = int(waiting[0])
        asked[q] = True
        mark[ranked[q]] = 1
        for other in trie.overlaps(ranked[q], mark, num, den):
            if root[other] != root[q]:
                links.append((int(nodes[q]), int(nodes[other])))
                root[root == root[other]] = root[q]
        mark[ranked[q]] = 0


# ---------------------------------------------------------------- Spark


def each_chunk(docs: DataFrame, doc_id: str, text: str, make, schema: str) -> DataFrame:
    """``make`` applied to (ids, lower-case texts) of about CHUNK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, lower=True):
            yield from make(ids, texts)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, schema)


def _places(hashes: np.ndarray, parts: int, size: int) -> list[np.ndarray]:
    """The two bits of a filter, all parts in a row, that stand for each hash."""
    part, mixed = hashes % parts, mix(hashes.view(np.uint64))
    return [part * size + ((mixed >> np.uint64(shift)) % np.uint64(size)).astype(np.int64) for shift in (0, 32)]


def perhaps_in(ids: DataFrame):
    """A function of an id column that is true for every id of ``ids`` (id) and for few others, so that rows that no join can match are left where they are."""
    size = FILTER_PART
    parts = int(min(max(ids.count() * FILTER_BITS // size, 1), FILTER_MOST // size))

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        bits = np.zeros(size, dtype=bool)
        for places in _places(group.column("hash").to_numpy(), parts, size):
            bits[places % size] = True
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

    hashed = ids.select(F.xxhash64("id").alias("hash")).withColumn("part", F.pmod("hash", F.lit(parts)))
    known = np.zeros(parts * size // 8, dtype=np.uint8)
    for row in hashed.groupBy("part").applyInArrow(fill, "part long, bits binary").collect():  # FILTER_MOST bits at most
        known[row.part * size // 8 : (row.part + 1) * size // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        found = np.ones(len(hashes), dtype=bool)
        for places in _places(hashes.to_numpy(), parts, size):
            found &= (shared.value[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return lambda id: held(F.xxhash64(id))


def _scan(docs: DataFrame, doc_id: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """A row for each document: (id, n_shingles, node, band, and the node's ids in its two bands), and
    rows with each task's part of the sketch: (part, counters, counts), the latter of non-zero ones or of all.
    """
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = ["id", "n_shingles", "node", "band", "first", "second", "part", "counters", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, dtype=np.int64)
        for ids, texts in text_chunks(batches, lower=True):
            holder, grams, sizes = sets_of(texts, n)
            sketch += np.bincount(counter_of(grams), minlength=SKETCH)
            nodes, (own, lower) = nodes_of(holder, grams, sizes), bands_of(sizes, num, den)
            columns = [pa.array(ids, pa.int64()), *map(pa.array, (sizes.astype(np.int64), nodes, own, in_band(nodes, own), in_band(nodes, lower)))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(ids), t) for t in types[6:])], names)
        size = min(SKETCH, SKETCH_PART)
        for part in range(SKETCH // size):
            counts = np.minimum(sketch[part * size : (part + 1) * size], 65_535).astype(np.uint16)  # far over any limit
            some = np.flatnonzero(counts)
            if len(some):
                packed = (b"", counts.tobytes()) if 2 * len(some) > size else (some.astype(np.uint16).tobytes(), counts[some].tobytes())
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:6]), *(pa.array([v], t) for v, t in zip((part, *packed), types[6:]))], names)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "id long, n_shingles long, node long, band long, first long, second long, part int, counters binary, counts binary")


def _frequent(scanned: DataFrame) -> np.ndarray:
    """Whether each counter of the sketch is frequent: SKETCH truth values, whatever the corpus holds."""
    size = min(SKETCH, SKETCH_PART)

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(size, dtype=np.int64)
        for counters, counts in zip(group.column("counters"), group.column("counts")):
            value = np.frombuffer(counts.as_py(), dtype=np.uint16)
            at = np.frombuffer(counters.as_py(), dtype=np.uint16)
            total[at if len(at) else slice(None)] += value
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    sums = scanned.where("part IS NOT NULL").select("part", "counters", "counts").groupBy("part").applyInArrow(add, "part int, total binary")
    sketch = np.zeros(SKETCH, dtype=np.int64)
    for row in sums.collect():  # SKETCH numbers in all
        sketch[row.part * size : (row.part + 1) * size] = np.frombuffer(row.total, dtype=np.int64)
    return sketch > max(2.0, FREQUENT * sketch.mean())


def _ranges(members: DataFrame, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bucket, buckets) of each band: its keys in ranges of about KEYS_PER_RANGE."""
    sizes = {r.band: r["count"] for r in members.where("n_shingles > 0").groupBy("band").count().collect()}  # one row for each size class
    bands = np.arange(max(sizes, default=0) + 1)
    sets = np.array([sizes.get(b, 0) + sizes.get(b + 1, 0) for b in bands.tolist()])
    n = 1 + sets * (most_differing(bands, num, den) + 1) // KEYS_PER_RANGE
    return np.cumsum(n) - n, n


def _candidates(docs: DataFrame, members: DataFrame, frequent: np.ndarray, doc_id: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """(a, b): ids in a band that share a segment key with others, each with one of those."""
    base, count = _ranges(members, num, den)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make(ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        holder, grams, sizes = sets_of(texts, n)
        found, nodes = segment_keys(holder, grams, sizes, num, den, shared.value), nodes_of(holder, grams, sizes)
        keys, of, bands = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(bands, kind="stable")
        keys, of, bands = keys[order], of[order], bands[order]
        for part in np.split(np.arange(len(bands)), np.flatnonzero(bands[1:] != bands[:-1]) + 1):
            if len(part):
                band = int(bands[part[0]])
                yield from exchange.rows(keys[part], in_band(nodes[of[part]], bands[part]), int(count[band]), int(base[band]), hooked)

    def star(key: tuple, group: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(x) for x in hooked(*exchange.links(group))], ["a", "b"])

    sent = each_chunk(docs, doc_id, text, make, exchange.PAIRS)
    return sent.groupBy("bucket").applyInArrow(star, "a long, b long")


def _set_rows(docs: DataFrame, dealt: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(node, comp, chunk, size, grams) of the nodes in ``dealt`` (id, node, comp, chunk), from one document each.

    Only texts that may be wanted are moved.
    """
    wanted = dealt.groupBy("id", "node").agg(F.collect_list(F.struct("comp", "chunk")).alias("places"))  # two at most
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text).where(perhaps_in(dealt)("id")).join(wanted.hint("shuffle_hash"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in text_chunks(iter([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(1)], ["i", "text"])]), lower=True):
                holder, grams, sizes = sets_of(texts, n)
                found = nodes_of(holder, grams, sizes)
                part = batch.take(pa.array(keys))
                _, first = np.unique(found, return_index=True)  # rows of one id and text are needed once
                good = np.zeros(len(found), dtype=bool)
                good[first] = True
                good &= found == np.array(part.column(2).to_pylist(), dtype=np.int64)  # a repeated id may hold another text
                cuts = np.cumsum(sizes)
                packed = [grams[c - s : c].tobytes() for c, s in zip(cuts, sizes)]
                whole = pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(sizes.astype(np.int64)), pa.array(packed, pa.binary())], ["node", "places", "size", "grams"])
                yield whole.filter(pa.array(good))

    found = rows.select("id", text, "node", "places").mapInArrow(run, "node long, places array<struct<comp:long,chunk:long>>, size long, grams binary")
    return found.select("node", F.explode("places").alias("p"), "size", "grams").select("node", "p.comp", "p.chunk", "size", "grams")


def _join_chunks(rows: DataFrame, num: int, den: int, linker) -> DataFrame:
    """Links (a, b) within each (comp, chunk); rows with ``asks`` false are only searched."""

    def join(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("node")
        nodes = group.column("node").to_numpy()
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        keep = np.concatenate(([True], nodes[1:] != nodes[:-1]))
        sets = [np.frombuffer(b.as_py(), dtype=np.uint64) for b, k in zip(group.column("grams"), keep) if k]
        asking = np.maximum.reduceat(asks.astype(int), np.flatnonzero(keep)).astype(bool)
        links = linker(nodes[keep], sets, num, den, None if asking.all() else asking) if len(sets) > 1 else []
        return pa.Table.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.groupBy("comp", "chunk").applyInArrow(join, "a long, b long")


def _dealt(names: DataFrame, salt: int) -> DataFrame:
    """``names`` (node, comp, size, ...) with ``chunk`` and ``chunks``: so many that none has over CHUNK_SETS sets or CHUNK_GRAMS n-grams on average."""
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("size") / CHUNK_GRAMS))
    large = materialize(names.groupBy("comp").agg(chunks.alias("chunks")).where("chunks > 1"))
    if large.limit(FEW + 1).count() <= FEW:  # the rows of a large component need not meet in one task
        large = F.broadcast(large)
    dealt = names.join(large, "comp", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    return dealt.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("chunks")))


def links(docs: DataFrame, dealt: DataFrame, doc_id: str, text: str, n: int, num: int, den: int, linker=trie_links) -> DataFrame:
    """Links (a, b) that span the components of all links among the sets of each candidate component; ``linker`` finds those of a chunk."""
    everyone = F.lit(True).alias("asks")
    found = materialize(_join_chunks(_set_rows(docs, dealt, doc_id, text, n).select("*", everyone), num, den, linker))
    many = dealt.where("chunks > 1")
    if many.isEmpty():
        return found
    names = many.select("node", "comp", "size", "chunks")
    split = materialize(_set_rows(docs, many, doc_id, text, n).drop("chunk", "size"))
    labelled = lambda: names.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    # One set stands for each component that the chunks have found; these are joined among themselves.
    head = labelled().groupBy("comp", "label").agg(F.min(F.struct("node", "size")).alias("h")).select("h.node", "comp", "h.size")
    heads = split.join(_dealt(head, 2).drop("size"), ["comp", "node"]).select("*", everyone)
    found = materialize(found.unionByName(_join_chunks(heads, num, den, linker)))
    # All pairs that are not yet connected have an end outside the candidate component's largest part.
    every = materialize(labelled())
    largest = every.groupBy("comp", "label").count().groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    asking = every.join(largest, "comp").where("label <> main").drop("main", "label")
    if asking.isEmpty():
        return found
    blocks = asking.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("size") / CHUNK_GRAMS)).alias("blocks"))
    place = lambda row, side: row * F.lit(1 << 20) + side
    row = F.pmod(F.xxhash64("node", F.lit(4)), F.col("blocks"))
    side = F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks"))
    asked = asking.join(blocks, "comp").withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("comp", "node", place(row, F.col("side")).alias("chunk"), everyone)
    searched = every.join(blocks, "comp").withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("comp", "node", place(F.col("row"), side).alias("chunk"), F.lit(False).alias("asks"))
    return found.unionByName(_join_chunks(split.join(asked.unionByName(searched), ["comp", "node"]), num, den, linker))


def dealt_out(names: DataFrame) -> DataFrame:
    """``names`` (id, node, size, comp) of candidates with the chunk of their component that each is dealt to."""
    return materialize(_dealt(materialize(names), 1))


def _by_node(rows: DataFrame, values: DataFrame) -> DataFrame:
    """``rows`` with the ``values`` (node, rows, ...) of their node; a node that very many rows hold is joined in shares."""
    hot = materialize(values.where(F.col("rows") > HOT_ROWS).select("node", F.ceil(F.col("rows") / HOT_ROWS).alias("shares")))
    if hot.isEmpty() or hot.limit(FEW + 1).count() > FEW:
        return rows.join(values.drop("rows"), "node", "left")
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    rows = rows.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(hot), "node", "left").withColumn("share", F.pmod(F.xxhash64("place"), shares)).drop("shares", "place")
    values = values.join(F.broadcast(hot), "node", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("shares", "rows")
    return rows.join(values, ["node", "share"], "left").drop("share")


def labelled(members: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """(id, n_shingles, component_id) of all ``members`` (id, n_shingles, node), given the links between nodes."""
    real = members.where("n_shingles > 0 AND id IS NOT NULL")
    linked = components(found)
    # Rows of one id are one document: what any of them links with belongs to its class.
    held = real.select("id", "node").distinct()
    several = held.groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").drop("most")
    if not several.isEmpty():
        same = held.join(several, "id").select(F.col("node").alias("a"), F.col("least").alias("b"))
        linked = components(linked.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(same))
    holders = real.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    named = materialize(holders.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    by_node = named.join(least, "label").select("node", "component_id", "rows")
    worded = _by_node(members.where("n_shingles > 0"), by_node).select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    empty = members.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return worded.unionByName(empty).withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id"))).withColumnRenamed("id", doc_id)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row: texts link when den * intersection >= num * union."""
    scanned = materialize(_scan(docs, doc_id, text, n, num, den))
    members = scanned.where("part IS NULL").drop("part", "counters", "counts")
    near = components(_candidates(docs, members, _frequent(scanned), doc_id, text, n, num, den))
    holders = members.where("n_shingles > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("first").alias("first"), F.first("second").alias("second"), F.first("n_shingles").alias("size"))
    placed = holders.select("id", "node", "size", F.explode(F.array("first", "second")).alias("in_band"))
    dealt = dealt_out(placed.join(near.toDF("in_band", "comp"), "in_band").drop("in_band"))
    return labelled(members.select("id", "n_shingles", "node"), links(docs, dealt, doc_id, text, n, num, den), doc_id)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each class, that of its smallest id, and all rows without words; the columns are those of ``docs``.

    Rows without an id take part under a number made from their text, after usual ids. Of rows with
    one id only one stays, that with the smallest hash of its content.
    """
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(UNNAMED) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))
    # The row travels as one value, so no name in it can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), number.alias("id"))
    found = materialize(classes(docs.select(number.alias("id"), F.col(text).alias("text")), "id", "text", n, num, den).where("n_shingles > 0"))
    gone = found.where("id <> component_id").select("id").distinct().withColumn("worded", F.lit(True))
    again = found.groupBy("id").count().where("count > 1").select("id").withColumn("worded", F.lit(True))
    concerned = perhaps_in(gone.union(again))
    worded = F.coalesce(F.col(f"row.`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded")
    kept = rows.where(concerned("id")).select("row", "id", worded).join(gone.hint("shuffle_hash"), ["id", "worded"], "left_anti")
    if not again.isEmpty():
        single = kept.join(again.hint("shuffle_hash"), ["id", "worded"], "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.join(again.hint("shuffle_hash"), ["id", "worded"], "left_anti").select("row").unionByName(single.select("row"))
    return rows.where(~concerned("id")).select("row").unionByName(kept.select("row")).select("row.*")
