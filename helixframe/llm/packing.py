"""Packing documents into fixed token windows by Karmarkar-Karp multiway differencing.

Each document's ids are cut at multiples of the capacity; full pieces are windows of their own.
What remains, cut to at most CUT ids a piece, is dealt by hash into groups of about GROUP_DOCS documents, and each group is
differenced: the two partial partitions with the largest imbalances are merged, opposing the
largest sums of one to the smallest of the other, until one partition into k near-equal windows is
left. k starts at the least possible count and rises whenever a window exceeds the capacity. Only
the pieces' few numbers are shuffled, never ids or texts, and a group's size does not grow with
the corpus: a row's group depends on its place too, so repeated rows are dealt out like others, the full
pieces of a long document form groups of SPAN windows, and at most GROUP_PIECES pieces are differenced together.

Defined cases: null and empty texts have the end id alone; a null id is kept. Repeated rows are
packed as often as they occur. Very long texts are encoded in segments that end at a space, so that only
their ids are held whole. An empty table gives no pieces. Input columns other than the id and the text are
ignored, so their names cannot clash. Which documents share a window depends on how the table is partitioned.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
#: Documents of one differencing group, on average.
GROUP_DOCS = 512
#: Pieces that are differenced together, at most, and windows of one group of a long document.
GROUP_PIECES, SPAN = 2048, 256
#: Remainders are cut to this, so that a window has several and their sums come out even.
CUT = 512
END_ID = 1
#: Longer parts of words are not kept for reuse; of more than so many parts, the half used last is kept.
KEPT_CHARS, KEPT_PARTS = 48, 1_000_000
BATCH_CHARS = 8 << 20
#: Longer texts are encoded in segments of about this.
SEGMENT_CHARS = 1 << 20
#: Words that are one run of letters after any normalisation, within ASCII marks in which no contraction or special token begins.
LETTERS, MARKS = r"[a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+", r"[!-&(-/:;=-@\[-`{-~]*"
PLAIN, PARTED = f"^{LETTERS}$", f"^(?P<before>{MARKS})(?P<letters>{LETTERS})(?P<after>{MARKS})$"
#: Words that are encoded in one text, and in one call.
RUN_WORDS, CALL_WORDS = 500, 20_000


def binary(ids: np.ndarray, lengths: np.ndarray) -> pa.LargeBinaryArray:
    """One value of so many ids for each length."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids)])


class WordIds:
    """Token ids by parts of white-space words: the tokenizer never joins across white space, nor letters with marks.

    Each distinct part of a batch is looked up once, and encoded if it is not among the parts used of late.
    """

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.turn = np.zeros(0, dtype=np.int64), 0

    @staticmethod
    def spaced(text: str) -> str:
        """Words between single spaces, with A-Z lower as the tokenizer makes them; texts with special tokens keep their case."""
        if "<|" not in text:
            text = text.lower() if text.isascii() else text.encode().lower().decode()
        for space in "\n\r\t":
            text = text.replace(space, " ")
        return text

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, dtype="<u4") for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _single(self, parts: pa.LargeStringArray) -> list[pa.LargeBinaryArray]:
        """Ids of parts of any kind."""
        calls = [self._encode(parts[at : at + CALL_WORDS].to_pylist()) for at in range(0, len(parts), CALL_WORDS)]
        return [binary(np.concatenate(ids), np.array([len(x) for x in ids])) for ids in calls]

    def _plain(self, parts: pa.LargeStringArray) -> list[pa.LargeBinaryArray]:
        """Ids of runs of Latin letters, each of which ends with one word-ending id."""
        found = []
        for at in range(0, len(parts), CALL_WORDS):
            call = parts[at : at + CALL_WORDS]
            runs = [call[i : i + RUN_WORDS] for i in range(0, len(call), RUN_WORDS)]
            for run, ids in zip(runs, self._encode([" ".join(run.to_numpy(zero_copy_only=False)) for run in runs])):
                cuts = np.flatnonzero(self.ends[ids]) + 1
                found += [binary(ids, np.diff(cuts, prepend=0))] if len(cuts) == len(run) else self._single(run)
        return found

    def _known(self, parts: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct parts."""
        place = pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy().astype(np.int64)
        new = place < 0
        if new.any():
            wanted = parts.filter(pa.array(new))
            plain = pc.match_substring_regex(wanted, PLAIN)
            letters, others = wanted.filter(plain), wanted.filter(pc.invert(plain))
            place[new] = len(self.parts) + np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            self.ids = pa.concat_arrays([self.ids, *self._plain(letters), *self._single(others)])
            self.parts = pa.concat_arrays([self.parts, letters, others])
            self.used = np.concatenate([self.used, np.zeros(len(wanted), dtype=np.int64)])
        self.turn += 1
        self.used[place] = self.turn
        found = self.ids.take(pa.array(place))
        if new.any():
            self._forget()
        return found

    def _forget(self) -> None:
        keep = pc.less_equal(pc.utf8_length(self.parts), KEPT_CHARS).to_numpy(zero_copy_only=False)
        if len(keep) > KEPT_PARTS:
            keep[np.argsort(self.used, kind="stable")[: -(KEPT_PARTS // 2)]] = False
        if not keep.all():
            self.parts, self.ids, self.used = self.parts.filter(pa.array(keep)), self.ids.filter(pa.array(keep)), self.used[keep]

    def _words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words; one that is not letters within marks is a part of its own."""
        parted = pc.extract_regex(words, PARTED)
        before, letters, after = parted.flatten()
        none = pa.scalar("", pa.large_string())
        sides = [pc.fill_null(before, none), pc.coalesce(letters, words), pc.fill_null(after, none)]
        parts = pa.concat_arrays(sides).dictionary_encode()
        ids, n = self._known(parts.dictionary).take(parts.indices), len(words)
        return pc.binary_join_element_wise(ids[:n], ids[n : 2 * n], ids[2 * n :], pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text."""
        split = pc.split_pattern(pa.array([self.spaced(t) for t in texts], pa.large_string()), " ")
        words = split.values.dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices)
        _, places, raw = ids.buffers()
        ends = np.frombuffer(places, dtype=np.int64)[split.offsets.to_numpy()].tolist()
        held = memoryview(raw or b"")
        return [bytes(held[begin:end]) for begin, end in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """A worker's tasks share the words that it has encoded."""
    return WordIds(path)


PIECE = ["start", "length", "ids_crc32", "doc_tokens"]


def segments(text: str) -> list[str]:
    """The text in parts that end at a space."""
    parts, at = [], 0
    while len(text) - at > SEGMENT_CHARS:
        space = text.find(" ", at + SEGMENT_CHARS)
        if space < 0:
            break
        parts.append(text[at:space])
        at = space
    return [*parts, text[at:]]


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, cut: int = CUT) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, place).

    ``place`` tells rows apart that are equal: the task and how many such rows it had before.
    """
    end = np.array([END_ID], dtype="<u4").tobytes()
    names = ["id", *PIECE, "place"]
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = word_ids(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                parts, owner, stop, size = [], [], at, 0
                while stop < len(texts) and size < BATCH_CHARS:
                    whole = texts[stop] or ""
                    size += len(whole)
                    held = segments(whole) if len(whole) > SEGMENT_CHARS else [whole]
                    parts += held
                    owner += [stop] * len(held)
                    stop += 1
                encoded = coder.encode(parts)
                joined = encoded if len(encoded) == stop - at else [b"".join(p for p, o in zip(encoded, owner) if o == i) for i in range(at, stop)]
                of, rows = [], []
                for i, ids in enumerate(joined, at):
                    ids += end
                    total = len(ids) // 4
                    row = hash((keys[i], total, zlib.crc32(ids)))
                    seen[row] = before = seen.get(row, -1) + 1
                    full = total - total % capacity
                    for start in [*range(0, full, capacity), *range(full, total, cut)]:
                        part = ids[4 * start : 4 * (start + (capacity if start < full else cut))]
                        of.append(i)
                        rows.append((start, len(part) // 4, zlib.crc32(part), total, task << 32 | before))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], names)
                at = stop

    return docs.select(F.col(doc_id).alias("id"), text).mapInArrow(run, schema)


def difference(lengths: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp: a window of 0 to k - 1 for each length, with near-equal sums."""
    n = len(lengths)
    if k == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    sums: list[np.ndarray | None] = []
    for x in lengths:
        first = np.zeros(k, dtype=np.int64)
        first[-1] = x
        sums.append(first)
    merged: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(x), i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]  # both ascend: largest meets smallest
        order = np.argsort(total, kind="stable")
        total = total[order]
        total -= total[0]
        sums[a] = sums[b] = None
        sums.append(total)
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(total[-1]), len(sums) - 1))
    slots: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for number in range(len(merged) - 1, -1, -1):
        a, b, order = merged[number]
        here = slots.pop(n + number)
        back = np.empty(k, dtype=np.int64)
        back[order] = here  # the window of each place before sorting
        slots[a], slots[b] = back, back[::-1]
    return np.array([slots[i][-1] for i in range(n)], dtype=np.int64)


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """A window for each length; the count rises from the least possible, by what exceeds the capacity, until none does."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = difference(lengths, k)
        over = np.maximum(np.bincount(window, weights=lengths, minlength=k) - capacity, 0).sum()
        if not over:
            return window
        k += max(1, int(over) // capacity)


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, cut: int = CUT) -> DataFrame:
    """All pieces with ``sequence_id`` and gapless ``offset``; a sequence id is a group's number and a count in it."""
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    found = pieces(docs, vocabulary, doc_id, text, capacity, cut)
    span = F.floor(F.col("start") / (capacity * SPAN))
    apart = (F.col("length") == capacity) & (span > 0)  # full pieces need no others
    row = [F.col("id"), F.col("doc_tokens"), F.col("place")]
    group = F.when(apart, groups + F.pmod(F.xxhash64(*row, span), F.lit(1 << 30))).otherwise(F.pmod(F.xxhash64(*row), F.lit(groups)))
    dealt = found.withColumn("group", group).drop("place")
    names = ["id", *PIECE]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        full = (frame["length"] == capacity).to_numpy()
        window = np.zeros(len(frame), dtype=np.int64)
        window[full] = np.arange(full.sum())
        rest, used = np.flatnonzero(~full), int(full.sum())
        lengths = frame["length"].to_numpy()
        for at in range(0, len(rest), GROUP_PIECES):
            part = rest[at : at + GROUP_PIECES]
            some, number = np.unique(windows(lengths[part], capacity), return_inverse=True)
            window[part] = used + number
            used += len(some)
        frame["sequence_id"] = frame["group"].astype("int64") * (1 << 32) + window
        order = np.argsort(window, kind="stable")
        length = lengths[order]
        before = np.cumsum(length) - length
        first = np.searchsorted(window[order], window[order], side="left")
        offset = np.empty(len(frame), dtype=np.int64)
        offset[order] = before - before[first] if len(frame) else before
        frame["offset"] = offset
        return frame[[*names, "sequence_id", "offset"]]

    schema = T.StructType([*(found.schema[n] for n in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    packed = dealt.groupBy("group").applyInPandas(place, schema)
    return packed.select(F.col("id").alias(doc_id), *PIECE, "sequence_id", "offset")
