"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window of ``length`` words of every whole text is hashed; a window repeats if its hash also
occurs in a document with a smaller id. Repeated windows merge into maximal removal intervals. The
hash has 64 bits; two different windows share one with a chance of about (windows squared) / 2^65.

Defined cases: null and empty texts, and texts shorter than a window, lose nothing. Rows of the
same id are one document's parts: a window that only they hold is kept; very many of them are dealt out. A row with a null id is
kept whole and takes no part. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import text_chunks, window_hashes, word_hashes

WINDOW = 13
#: Characters of text that are joined with their repeated windows at a time.
CHARS_PER_GROUP = 2_000_000
#: Rows of one id beyond so many are dealt out, for so many ids at most.
HOT_ROWS, FEW = 10_000, 200


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each id by its hash, as ``_group`` gives it."""
    some, place = np.unique(ids, return_inverse=True)
    return np.array([zlib.crc32(str(i).encode()) % groups for i in some.tolist()], dtype=np.int64)[place]


def _group(number: F.Column, groups: int) -> F.Column:
    return F.crc32(number.cast("string")) % groups


def crowded(docs: DataFrame, doc_id: str) -> dict[int, int]:
    """Ids that over HOT_ROWS rows share, and in how many shares each is dealt out; none if they are more than FEW."""
    number = F.col(doc_id).cast("long").alias("id")
    found = docs.select(number).where("id IS NOT NULL").groupBy("id").count().where(F.col("count") > HOT_ROWS)
    rows = found.select("id", F.ceil(F.col("count") / HOT_ROWS).alias("shares")).limit(FEW + 1).collect()
    return {r.id: r.shares for r in rows} if len(rows) <= FEW else {}


def repeated_windows(docs: DataFrame, doc_id: str, text: str, length: int, groups: int, shares: dict[int, int]) -> DataFrame:
    """(group, keys, ids): hashes of the windows that a smaller id holds too, by group of documents; those of an id in ``shares`` for each share."""
    n = exchange.ranges(docs, text)
    first = dict(zip(shares, (groups + np.cumsum([0, *shares.values()])).tolist()))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            known = [i for i, key in enumerate(ids) if key is not None]
            words, owner = word_hashes([texts[i] for i in known])
            hashes, first = window_hashes(words, owner, length)
            numbers = np.array([ids[i] for i in known], dtype=np.int64)
            yield from exchange.rows(hashes, numbers[owner[first]] if len(first) else np.zeros(0, dtype=np.int64), n)

    def repeats(key: tuple, group: pa.Table) -> pa.Table:
        keys, ids, _ = exchange.holders(group)
        number = group_of(ids, groups)
        for hot in shares:
            if (own := ids == hot).any():  # their rows are in several groups, so each gets a copy
                copies = np.repeat(first[hot] + np.arange(shares[hot]), int(own.sum()))
                keys, ids, number = np.concatenate((keys[~own], np.tile(keys[own], shares[hot]))), np.concatenate((ids[~own], np.full(len(copies), hot))), np.concatenate((number[~own], copies))
        order = np.argsort(number, kind="stable")
        keys, ids, number = keys[order], ids[order], number[order]
        edges = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else np.zeros(0, dtype=np.int64)
        cuts = np.append(edges, len(number))
        parts = [slice(a, z) for a, z in zip(cuts[:-1], cuts[1:])]
        columns = [pa.array(number[edges], pa.int64()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([ids[p].tobytes() for p in parts], pa.binary())]
        return pa.Table.from_arrays(columns, ["group", "keys", "ids"])

    sent = docs.select(F.col(doc_id).cast("long"), text).mapInArrow(windows, exchange.PAIRS)
    return sent.groupBy("bucket").applyInArrow(repeats, "group long, keys binary, ids binary")


def _intervals(repeated: np.ndarray, length: int) -> np.ndarray:
    """Maximal [start, end) intervals that the windows at these starts cover."""
    if not len(repeated):
        return np.zeros((0, 2), dtype=np.int64)
    new = np.concatenate(([True], repeated[1:] > repeated[:-1] + length))
    starts = repeated[new]
    ends = repeated[np.append(np.flatnonzero(new)[1:] - 1, len(repeated) - 1)] + length
    return np.stack((starts, ends), axis=1)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """(id, n_words, intervals, kept): each document's removal intervals, in words, and what is left."""
    groups, shares = exchange.ranges(docs, text, CHARS_PER_GROUP), crowded(docs, doc_id)
    repeats = repeated_windows(docs, doc_id, text, length, groups, shares)
    number, row = F.col(doc_id).cast("long"), F.pmod(F.xxhash64(text, F.monotonically_increasing_id()), F.lit(1 << 40))
    group = F.coalesce(_group(number, groups), row % groups)  # a row without an id can be anywhere
    at = groups
    for hot, n in shares.items():
        group, at = F.when(number == hot, at + row % n).otherwise(group), at + n
    keyed = docs.select(number.alias("id"), F.col(text).alias("text"), group.alias("group"))

    def remove(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(b.as_py(), dtype=np.uint64) for b in found.column("keys")] or [np.zeros(0, dtype=np.uint64)])
        holder = np.concatenate([np.frombuffer(b.as_py(), dtype=np.int64) for b in found.column("ids")] or [np.zeros(0, dtype=np.int64)])
        order = np.argsort(holder, kind="stable")
        keys, holder = keys[order], holder[order]
        out: list[list] = [[], [], [], []]
        for number, whole in zip(texts.column("id").to_pylist(), texts.column("text").to_pylist()):
            raw = (whole or "").encode()
            words = raw.split()
            spans = np.zeros((0, 2), dtype=np.int64)
            if number is not None and (mine := keys[np.searchsorted(holder, number) : np.searchsorted(holder, number, side="right")]).size:
                hashed, owner = word_hashes([raw])
                windows, first = window_hashes(hashed, owner, length)
                spans = _intervals(first[np.isin(windows, mine)], length)
            kept, at = [], 0
            for a, z in spans.tolist():
                kept += words[at:a]
                at = z
            kept += words[at:]
            for column, value in zip(out, (number, len(words), [{"start": a, "end": z} for a, z in spans.tolist()], b" ".join(kept).decode())):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["id", "n_words", "intervals", "kept"])

    joined = keyed.groupBy("group").cogroup(repeats.groupBy("group")).applyInArrow(remove, "id long, n_words long, intervals array<struct<start:long,end:long>>, kept string")
    return joined.withColumnRenamed("id", doc_id)
