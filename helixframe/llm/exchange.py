"""A compact shuffle of (64-bit key, id) pairs: Arrow rows that hold many pairs of one key range.

Each map task first reduces its own pairs: of the ids that share a key only the smallest goes on;
the others are settled at once. So a key that a third of all rows hold reaches its reducer once
for each map chunk, not once for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of input for each key range; about 2 million pairs, 30 MB in numpy.
CHARS_PER_RANGE = 16_000_000
PAIRS = "bucket long, settled boolean, keys binary, ids binary, counts binary, others binary"
NAMES = [c.split()[0] for c in PAIRS.split(", ")]
TYPES = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def ranges(docs: DataFrame, text: str, per_range: int = CHARS_PER_RANGE) -> int:
    """How many key ranges the texts need."""
    total = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return int(total // per_range) + 1


def minima(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their smallest id), and (key, id, smallest id) of every other holder, each once."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    if not len(keys):
        return keys, ids, keys, ids, ids
    new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
    least = ids[np.maximum.accumulate(np.where(new_key, np.arange(len(keys)), 0))]
    rest = new & ~new_key
    return keys[new_key], ids[new_key], keys[rest], ids[rest], least[rest]


def rows(keys: np.ndarray, ids: np.ndarray, n: int, base: int = 0, settle=None) -> Iterator[pa.RecordBatch]:
    """What one map chunk sends to the buckets base to base + n - 1: its minima by key range, and its settled holders, dealt evenly.

    ``settle`` makes (ids, least) of the settled (ids, least), where their keys are not needed further.
    """
    heads, head_ids, rest, rest_ids, least = minima(keys, ids)
    if settle is not None:
        rest_ids, least = settle(rest_ids, least)
        rest = rest_ids.view(np.uint64)
    bucket = ((heads >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    order = np.lexsort((head_ids, bucket))
    heads, head_ids, bucket = heads[order], head_ids[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n + 1, dtype=np.uint64))
    out: list[list] = [[] for _ in NAMES]
    for b in range(n):
        a, z = cuts[b], cuts[b + 1]
        if z > a:
            first = np.flatnonzero(np.concatenate(([True], head_ids[a + 1 : z] != head_ids[a : z - 1])))
            counts = np.diff(np.append(first, z - a)).astype(np.uint32)
            for column, value in zip(out, (base + b, False, heads[a:z].tobytes(), head_ids[a:z][first].tobytes(), counts.tobytes(), b"")):
                column.append(value)
    for at in range(0, len(rest), 50_000):
        part = slice(at, at + 50_000)
        number = base + (int(rest[at] % np.uint64(n)) if n > 1 else 0)
        own = rest[part].tobytes() if settle is None else b""
        for column, value in zip(out, (number, True, own, rest_ids[part].tobytes(), b"", least[part].tobytes())):
            column.append(value)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES)], NAMES)


def _received(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A bucket's open (keys, ids), and its settled (keys, ids, least) as they came."""
    keys, ids, done = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], []
    for r in group.to_batches():
        for _, settled, k, i, c, o in zip(*(r.column(j).to_pylist() for j in range(len(NAMES)))):
            k, i = np.frombuffer(k, dtype=np.uint64), np.frombuffer(i, dtype=np.int64)
            if settled:
                done.append((k, i, np.frombuffer(o, dtype=np.int64)))
            else:
                keys.append(k)
                ids.append(np.repeat(i, np.frombuffer(c, dtype=np.uint32)))
    return np.concatenate(keys), np.concatenate(ids), done


def holders(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, smallest id) of every holder of a key range's keys but the smallest."""
    keys, ids, done = _received(group)
    _, _, rest, rest_ids, least = minima(keys, ids)
    parts = [(rest, rest_ids, least), *done]
    return tuple(np.concatenate([p[j] for p in parts]) for j in range(3))


def links(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id) of holders of one key, for what was sent without the keys of settled holders."""
    keys, ids, done = _received(group)
    _, _, _, rest_ids, least = minima(keys, ids)
    return np.concatenate([rest_ids, *(d[1] for d in done)]), np.concatenate([least, *(d[2] for d in done)])
