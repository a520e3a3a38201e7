"""Alignment of two tokenizers by sparse incidence matrices over bytes.

Each text is encoded by a byte-level BPE vocabulary (A) and a sentence-piece vocabulary with byte fallback (B); both
see a space before it. Rows of the incidence matrices are tokens, columns are bytes; they are built in CSR by hand.

1. Texts are cut before every lone space between two characters that are not white space. Neither tokenizer joins
   across such a place (``Coder`` looks through the pieces of B and does not cut at all if one of them could), so each
   distinct part is encoded and aligned once for each batch of texts, and texts are put together from parts.
2. Overlap links of a part's tokens are the non-zeros of A·Bᵀ, by Gustavson's row products. Offsets where tokens of
   both end cut the bytes into groups; the product of the token-group incidences has the pairs that share a group. Their
   number needs its symbolic pass only, so a long group does not make all its pairs.
3. How many links of the corpus hold an (A id, B id) pair: each batch sends its own sums, packed in Arrow rows by the
   range of a hash of the pair; each range adds them up and answers every batch. The highest count of each B id is one
   number for each id of the vocabulary, and is all that is broadcast.
4. Texts (each its parts' numbers, packed) and answers are cogrouped by batch.

Defined cases: null and empty texts, and those whose tokens' bytes do not give back the text after a space, have no
tokens, no groups and no links, and count nowhere. Repeated rows count as often as they occur. Very long texts are
whole; a part without spaces is whole too. Ties of the highest count are all best. A null id is kept. An empty table
gives no rows. Columns other than those named are kept by ``weigh`` and ignored by ``align``, so names cannot clash.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix

#: A batch ends beyond so many characters of text.
BATCH_CHARS = 16_000_000
#: (batch, pair) entries of one range of pairs.
ENTRIES_PER_RANGE = 2_000_000
#: White space in any tokenizer's view.
SPACES = "\\s\u180e\u200b\ufeff"
CUT = re.compile(rf"(?<=[^{SPACES}])(?= [^{SPACES}])")
ODD = re.compile(rf"[{SPACES}]|.*[{SPACES}]\Z|\Z", re.DOTALL)
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]


# ---------------------------------------------------------------- sparse matrices


@dataclass
class Csr:
    """A matrix by rows: the columns of row i are indices[indptr[i]:indptr[i + 1]], ascending, with values."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    n_cols: int

    @property
    def n_rows(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate(([0], np.cumsum(np.bincount(self.indices, minlength=self.n_cols))))
        return Csr(indptr, self.rows()[order], self.values[order], self.n_rows)


def incidence(column: np.ndarray, row_sizes: np.ndarray, n_cols: int) -> Csr:
    """Rows with ones in the given columns, ``row_sizes`` of them each."""
    return Csr(np.concatenate(([0], np.cumsum(row_sizes))), column, np.ones(len(column), dtype=np.int64), n_cols)


def brought(a: Csr, b: Csr) -> np.ndarray:
    """For each non-zero of a, how many of b's it brings to its row of the product: the symbolic pass."""
    return np.diff(b.indptr)[a.indices]


def product(a: Csr, b: Csr) -> Csr:
    """a·b by Gustavson: each row gathers b's rows at its columns and adds up what meets in a column."""
    n = brought(a, b)
    row = np.repeat(a.rows(), n)
    at = np.repeat(b.indptr[a.indices] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    code = row * b.n_cols + b.indices[at]
    order = np.argsort(code, kind="stable")
    code, value = code[order], (np.repeat(a.values, n) * b.values[at])[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(value, first) if len(first) else value
    row = code[first] // b.n_cols if len(first) else code
    indptr = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=a.n_rows))))
    return Csr(indptr, code[first] % b.n_cols if len(first) else code, sums, b.n_cols)


@dataclass
class Aligned:
    """Tokens of some byte strings laid one after another, and how they meet."""

    a: np.ndarray  # ids
    b: np.ndarray
    groups_a: Csr  # tokens by groups
    groups_b: Csr
    overlaps: Csr  # A tokens by B tokens, values are shared bytes
    group_links: np.ndarray  # of each A token, with how many B tokens it shares its group

    def shared(self) -> Csr:
        """A tokens by B tokens of the same group: all pairs of each group."""
        return product(self.groups_a, self.groups_b.transposed())


def aligned(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Both sides' ids and their numbers of bytes, over the same bytes."""
    n = int(size_a.sum())
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    over = [incidence(np.arange(n), size, n) for size in (size_a, size_b)]
    cuts = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a]  # both ascend to the last byte
    group = [incidence(np.searchsorted(cuts, ends), np.ones(len(ends), dtype=np.int64), len(cuts)) for ends in (ends_a, ends_b)]
    return Aligned(a, b, *group, product(over[0], over[1].transposed()), brought(group[0], group[1].transposed()))


# ---------------------------------------------------------------- the tokenizers


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves, the others moved up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(moved)}


class Coder:
    """Ids and bytes of both tokenizers; A must be byte-level with the usual split into words, B byte-fallback BPE."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbol = byte_of_symbol()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    @property
    def size_b(self) -> int:
        return len(self.bytes_b)

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of parts that begin with their space."""
        found_a: list[list[int]] = []
        for at in range(0, len(parts), 10_000):
            found_a += [e.ids for e in self.a.encode_batch_fast(parts[at : at + 10_000], add_special_tokens=False)]
        return found_a, self.b.encode([p[1:] for p in parts], num_threads=1)


@functools.lru_cache(maxsize=2)
def coder(path_a: str, path_b: str) -> Coder:
    """A worker's tasks share the tokenizers."""
    return Coder(path_a, path_b)


# ---------------------------------------------------------------- one batch of texts


class Parts:
    """The distinct parts of a batch's texts, each encoded and aligned once."""

    def __init__(self, coding: Coder) -> None:
        self.coding = coding
        self.number: dict[str, int] = {}
        self.odd: set[str] = set()  # words that are parts together with what is next to them
        self.valid = np.zeros(0, dtype=bool)
        self.groups: list[str] = []
        self.counts = np.zeros((0, len(COUNTS)), dtype=np.int32)
        self.pairs: list[np.ndarray] = []  # the links of all parts, one after another, as pairs of ids

    def of(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's parts; no text is empty."""
        known, split = self.number, [t.split(" ") if self.coding.cuts else [t] for t in texts]
        fresh = [w for w in dict.fromkeys(itertools.chain.from_iterable(split)) if w not in known]
        odd = {w for w in fresh if ODD.match(w)} if self.coding.cuts else set()
        self.odd |= odd
        new = [w for w in fresh if w not in odd]
        if self.odd:
            for i, words in enumerate(split):
                if not self.odd.isdisjoint(words):  # white space that belongs to its neighbours
                    split[i] = [p if ODD.match(p[1:]) else p[1:] for p in CUT.split(" " + texts[i])]
                    new += split[i]
            new = [w for w in dict.fromkeys(new) if w not in known]
        self._learn(new, [w if w[:1] == " " and self.coding.cuts else " " + w for w in new])
        return [list(map(known.__getitem__, words)) for words in split]

    def _learn(self, names: list[str], parts: list[str]) -> None:
        if not parts:
            return
        ids_a, ids_b = self.coding.encode(parts)
        flat_a, flat_b = self._flat(ids_a, self.coding.bytes_a), self._flat(ids_b, self.coding.bytes_b)
        raw = [p.encode() for p in parts]
        good = self._same(raw, flat_a, self.coding.bytes_a) & self._same(raw, flat_b, self.coding.bytes_b)
        first = len(self.valid)
        self.number.update(zip(names, range(first, first + len(names))))
        self.valid = np.concatenate((self.valid, good))
        counts = np.zeros((len(parts), len(COUNTS)), dtype=np.int32)
        groups: list[str] = []
        if good.any():
            if not good.all():
                flat_a, flat_b = (self._flat([x for x, ok in zip(ids, good) if ok], table) for ids, table in ((ids_a, self.coding.bytes_a), (ids_b, self.coding.bytes_b)))
            counts[good], groups, links = self._aligned(flat_a, flat_b)
            self.pairs.append(links)
        self.counts = np.concatenate((self.counts, counts))
        shown = iter(groups)
        self.groups += groups if good.all() else [next(shown) if ok else "" for ok in good]

    @staticmethod
    def _same(raw: list[bytes], flat: tuple[np.ndarray, np.ndarray, np.ndarray], table: list[bytes]) -> np.ndarray:
        """Whether each part's tokens give back its bytes."""
        ids, n, sizes = flat
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(n)]
        joined, whole = b"".join([table[x] for x in ids.tolist()]), b"".join(raw)
        if joined == whole and (upto == np.cumsum([len(r) for r in raw])).all():
            return np.ones(len(raw), dtype=bool)
        begin = np.concatenate(([0], upto[:-1]))
        return np.array([joined[a:z] == r for a, z, r in zip(begin.tolist(), upto.tolist(), raw)])

    @staticmethod
    def _aligned(flat_a: tuple[np.ndarray, np.ndarray, np.ndarray], flat_b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Counts and groups of each part, and all parts' links."""
        (a, n_a, size_a), (b, n_b, size_b) = flat_a, flat_b
        met = aligned(a, size_a, b, size_b)
        to_a = np.cumsum(n_a)
        to_group = met.groups_a.indices[to_a - 1] + 1  # parts end with a group
        upto = np.stack((to_a, np.cumsum(n_b), to_group, met.overlaps.indptr[to_a], np.cumsum(met.group_links)[to_a - 1]), axis=1)
        of_a, of_b = met.groups_a.transposed().indptr.tolist(), met.groups_b.transposed().indptr.tolist()
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        shown = [f"{','.join(text_a[w:x])}|{','.join(text_b[y:z])}" for w, x, y, z in zip(of_a, of_a[1:], of_b, of_b[1:])]
        ends = to_group.tolist()
        groups = [shown[y] if z - y == 1 else ";".join(shown[y:z]) for y, z in zip([0, *ends], ends)]
        return np.diff(upto, axis=0, prepend=0), groups, met.a[met.overlaps.rows()] << 32 | met.b[met.overlaps.indices]

    @staticmethod
    def _flat(ids: list[list[int]], table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each part has, and each id's number of bytes."""
        flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64)
        return flat, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)), np.fromiter(map(len, table), dtype=np.int64, count=len(table))[flat]


def _packed(numbers: np.ndarray, times: np.ndarray) -> bytes:
    return zlib.compress(np.diff(numbers, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), dtype="<u4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _batch_row(parts: Parts, occurs: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """A batch's pairs in the order of their hashes, how often its texts' links hold each, and each part's links as places in them."""
    sizes = parts.counts[:, COUNTS.index("n_links")].astype(np.int64)
    flat = np.concatenate([*parts.pairs, np.zeros(0, dtype=np.int64)])
    pairs, place = np.unique(mix(flat.view(np.uint64)), return_inverse=True)
    _, first = np.unique(place, return_index=True)
    times = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(times, place, np.repeat(occurs, sizes))
    return flat[first].tobytes(), times.tobytes(), np.concatenate(([0], np.cumsum(sizes))).tobytes(), place.astype("<u4").tobytes()


# ---------------------------------------------------------------- Spark


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """A row for each text: (id, n_a, n_b, n_groups, n_links, n_group_links, groups, batch, parts), and one for each batch of
    texts, with ``pairs``, which ``weigh`` needs.

    ``groups`` has the ids of both sides by group, as a1,a2|b1;a3|b2,b3.
    """
    extra = ["batch", "parts", "pairs", "times", "starts", "places"]
    names = ["id", *COUNTS, "groups", *extra]
    kinds = [*[pa.int64()] * len(COUNTS), pa.large_string(), pa.int64(), *[pa.binary()] * 5]
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("groups", T.StringType()), T.StructField("batch", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in extra[1:])])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, number, id_type = coder(path_a, path_b), TaskContext.get().partitionId() << 32, None
        parts, occurs, size, open_ = Parts(coding), np.zeros(0, dtype=np.int64), 0, False

        def close() -> pa.RecordBatch:
            columns = [pa.nulls(1, id_type), *[pa.nulls(1, k) for k in kinds[:-6]], pa.array([number], pa.int64()), pa.nulls(1, pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([x], pa.binary()) for x in _batch_row(parts, occurs)]], names)

        for batch in rows:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [t or "" for t in some.column(1).to_pylist()]
                full = [i for i, t in enumerate(texts) if t]
                of = parts.of([texts[i] for i in full])
                flat = np.array([x for numbers in of for x in numbers], dtype=np.int64)
                owner = np.repeat(full, [len(numbers) for numbers in of]).astype(np.int64)
                bad = np.unique(owner[~parts.valid[flat]])
                ok = ~np.isin(owner, bad)
                flat, owner = flat[ok], owner[ok]
                occurs = np.concatenate((occurs, np.zeros(len(parts.valid) - len(occurs), dtype=np.int64)))
                occurs += np.bincount(flat, minlength=len(occurs))
                counts = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
                np.add.at(counts, owner, parts.counts[flat].astype(np.int64))
                code, times = np.unique(owner << 32 | flat, return_counts=True)
                cuts = np.searchsorted(code, np.arange(len(texts) + 1) << 32)
                packed = [_packed(code[a:z] & 0xFFFFFFFF, times[a:z]) for a, z in zip(cuts[:-1], cuts[1:])]
                gone, groups = set(bad.tolist()), [""] * len(texts)
                for i, numbers in zip(full, of):
                    if i not in gone:
                        groups[i] = ";".join(map(parts.groups.__getitem__, numbers))
                columns = [some.column(0), *[pa.array(c) for c in counts.T], pa.array(groups, pa.large_string()), pa.array([number] * len(texts), pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(texts), pa.binary())] * 4], names)
                size, open_ = size + sum(map(len, texts)), True
                if size >= batch_chars:
                    yield close()
                    parts, occurs, size, open_, number = Parts(coding), np.zeros(0, dtype=np.int64), 0, False, number + 1
        if open_:
            yield close()

    return docs.select(F.col(doc_id).alias("id"), text).mapInArrow(run, schema)


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64)


def pair_counts(batches: DataFrame, ranges: int) -> DataFrame:
    """Answers (batch, range, totals): how many links of all texts hold each of the batch's pairs of that range; and, without
    a batch, each range's (totals, ids): the highest total of each B id.
    """

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for number, pairs, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                pairs, times = _longs(pairs.as_py()), _longs(times.as_py())
                of = ((mix(pairs.view(np.uint64)) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))
                some = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
                columns = [pa.array(some, pa.int64()), pa.array([number] * len(some), pa.int64()), *[pa.array([x[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary()) for x in (pairs, times)]]
                yield pa.RecordBatch.from_arrays(columns, ["range", "batch", "pairs", "times"])

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        asked = [_longs(x.as_py()) for x in group.column("pairs")]
        pairs, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(total, place, np.concatenate([_longs(x.as_py()) for x in group.column("times")]))
        back = np.split(total[place], np.cumsum([len(x) for x in asked])[:-1])
        ids, of = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
        peak = np.zeros(len(ids), dtype=np.int64)
        np.maximum.at(peak, of, total)
        n = len(asked)
        columns = [pa.array([*group.column("batch").to_pylist(), None], pa.int64()), pa.array([key[0].as_py()] * (n + 1), pa.int64()), pa.array([*[x.tobytes() for x in back], peak.tobytes()], pa.binary()), pa.array([*[None] * n, ids.tobytes()], pa.binary())]
        return pa.Table.from_arrays(columns, ["batch", "range", "totals", "ids"])

    sent = batches.select("batch", "pairs", "times").mapInArrow(ask, "range long, batch long, pairs binary, times binary")
    return sent.groupBy("range").applyInArrow(answer, "batch long, range long, totals binary, ids binary")


def _peaks(answers: DataFrame, size: int) -> np.ndarray:
    """The highest total of each B id: as many numbers as the vocabulary has ids, whatever the corpus holds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, totals in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(_longs(ids.as_py())), pa.array(_longs(totals.as_py()))], ["id", "total"])

    found = answers.where("batch IS NULL").select("ids", "totals").mapInArrow(rows, "id long, total long").groupBy("id").agg(F.max("total").alias("total")).toArrow()
    peaks = np.zeros(size, dtype=np.int64)
    peaks[found.column("id").to_numpy()] = found.column("total").to_numpy()
    return peaks


def weigh(found: DataFrame, size_b: int) -> DataFrame:
    """The texts' rows of ``align`` (other columns may have been added or left out) with ``n_best`` and ``count_sum``:
    links whose pair is the most frequent of its B id, and the sum of all links' pair counts.
    """
    stored = materialize(found)
    batches = stored.where("pairs IS NOT NULL")
    entries = batches.agg(F.sum(F.length("pairs"))).first()[0] or 0
    answers = materialize(pair_counts(batches, int(entries // 8 // ENTRIES_PER_RANGE) + 1))
    peaks = stored.sparkSession.sparkContext.broadcast(_peaks(answers, size_b))
    own = ["batch", "parts", "pairs", "times", "starts", "places"]
    names = [c for c in stored.columns if c not in own]

    def add(key: tuple, rows: pa.Table, totals: pa.Table) -> pa.Table:
        held = rows.column("pairs").is_valid()
        batch, texts = rows.filter(held), rows.filter(pa.compute.invert(held))
        pairs, starts, places = (np.frombuffer(batch.column(c)[0].as_py(), dtype=kind) for c, kind in (("pairs", np.int64), ("starts", np.int64), ("places", "<u4")))
        total = np.concatenate([*[_longs(x.as_py()) for x in totals.sort_by("range").column("totals")], np.zeros(0, dtype=np.int64)])
        best = total == peaks.value[pairs & 0xFFFFFFFF]
        sums = [np.concatenate(([0], np.cumsum(x[places]))) for x in (best.astype(np.int64), total)]
        by_part = np.stack([s[starts[1:]] - s[starts[:-1]] for s in sums])
        out = np.zeros((texts.num_rows, 2), dtype=np.int64)
        for i, raw in enumerate(texts.column("parts")):
            numbers, times = _unpacked(raw.as_py())
            out[i] = by_part[:, numbers] @ times
        return pa.Table.from_arrays([*[texts.column(c) for c in names], *[pa.array(c) for c in out.T]], [*names, "n_best", "count_sum"])

    schema = T.StructType([*(stored.schema[c] for c in names), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return stored.groupBy("batch").cogroup(answers.where("batch IS NOT NULL").groupBy("batch")).applyInArrow(add, schema)
