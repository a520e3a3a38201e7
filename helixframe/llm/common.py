"""Helpers the corpus operators share: materialising, reading tables, and hashing words in Arrow batches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; whole texts only, so one long text makes a longer pass.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, which survives lost executors.

    The cluster names the folder in ``spark.checkpoint.dir``; only in a local master where that is
    unset (tests) is a temporary folder used. Elsewhere executors could not share one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="helixframe-"))
    return df.checkpoint(eager=True)


def free_name(columns: list[str], wish: str) -> str:
    """A helper column's name that no input column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def unit_hash(*cols) -> F.Column:
    """A uniform double in (0, 1) from the md5 of the joined columns: 52 bits, the same in any engine."""
    digest = F.md5(F.concat_ws("|", *cols))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that every bit of a hash depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        tables = []
        for b in (_BASE, _BASE_INVERSE):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit Rabin-Karp hashes of all words (runs without ASCII white space) and the text each belongs to.

    Long texts are hashed in blocks that end at white space, so only a word's own hash is held for the whole text.
    """
    joined = b"\n".join(texts) + b"\n"
    found, at = [], 0
    while at < len(joined):
        stop = at + CHUNK_BYTES
        if stop < len(joined):
            space = _SPACE.search(joined, stop)  # the last byte is one
            stop = space.end() if space else len(joined)
        hashes, starts = _block_hashes(joined[at:stop])
        found.append((hashes, starts + at))
        at = stop
    hashes, starts = (np.concatenate(x) for x in zip(*found))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, dtype=np.int64)
    return hashes, np.searchsorted(begin, starts, side="right") - 1


def _block_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a block."""
    data = np.frombuffer(block, dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate(([0], edges))
    if len(edges) % 2:
        edges = np.append(edges, len(data))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def window_hashes(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all n-word windows that lie in one text, and the window's first word."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        total = total * _BASE + words[j : len(words) - n + 1 + j]
    first = np.flatnonzero(owner[: len(total)] == owner[n - 1 :])
    return mix(total[first]), first


def text_chunks(batches: Iterator[pa.RecordBatch], id_col: int = 0, text_col: int = 1, lower: bool = False) -> Iterator[tuple[list, list[bytes]]]:
    """Whole (id, text) rows as lists of about CHUNK_BYTES; null texts are empty."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        column = batch.column(text_col).cast(pa.large_binary())
        for key, text in zip(batch.column(id_col).to_pylist(), column):
            raw = text.as_py() or b""
            ids.append(key)
            texts.append(raw.lower() if lower else raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
