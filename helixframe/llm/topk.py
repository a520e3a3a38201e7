"""Exact top-k inner products by columnar branch-and-bound over dimension blocks.

Vectors are dealt into blocks of rows and stored by dimension. A query goes over a block's
dimensions in groups, adds up partial products, and drops every candidate whose partial product
plus the most that its remaining dimensions can add (the product of both remaining masses) is
below the k-th best lower bound; what survives is compacted. The bound is exact, so ties and all,
the best k are the best k. Rows and queries are dealt into blocks and every block of rows meets every
block of queries in a group of its own; only a group's best k of each query go on.

A block of rows grows with the square root of the rows, to ROWS at most, so that query copies do not become
the larger part; a block of queries has about QUERIES at most. So what a group holds is bounded.

Defined cases: vectors that are null, or hold null, NaN or infinite components, take no part.
Only vectors of a query's own length are its candidates; vectors without components score 0.
Equal rows are separate candidates unless they have the query's own id; null ids take no part.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions of one step.
STEP = 8
#: Rows, and queries, of one block on average, at most.
ROWS, QUERIES = 16_384, 2_048


def quantized(vectors: DataFrame, vec_id: str, embedding: str, scale: int = 256) -> DataFrame:
    """(id, q): components as floor(scale * x) for the vectors that take part."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = F.col(embedding).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))


class Block:
    """Candidates in vertical layout: one row of numbers for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest: int) -> None:
        """``largest`` bounds the components of the rows and of the queries."""
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.dims = rows.shape[1]
        # Doubles add integers exactly up to 2^53, and faster.
        self.kind = np.float64 if float(largest) ** 2 * self.dims < 2.0**53 else np.int64
        self.by_dimension = np.ascontiguousarray(rows[order].T.astype(self.kind))
        square = self.by_dimension.astype(np.float64) ** 2
        steps = range(0, self.dims, STEP)
        # The mass that each candidate has from each step on, rounded up.
        self.rest = np.stack([np.sqrt(square[at:].sum(axis=0)) * (1 + 1e-12) for at in [*steps, self.dims]]) if self.dims else np.zeros((1, len(ids)))

    def best(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best candidates but ``own``, best first, ties to smaller ids."""
        alive = np.flatnonzero(self.ids != own)
        query = query.astype(self.kind)
        partial = np.zeros(len(alive), dtype=self.kind)
        mass = query.astype(np.float64) ** 2
        for number, at in enumerate(range(0, self.dims, STEP)):
            part = self.by_dimension[at : at + STEP]
            if len(alive) < part.shape[1]:
                part = part[:, alive]
            partial = partial + query[at : at + STEP] @ part
            reach = math.sqrt(float(mass[at + STEP :].sum())) * (1 + 1e-12) * self.rest[number + 1][alive]
            if len(alive) > k and number % 2:
                floor = np.partition(partial - reach, len(alive) - k)[len(alive) - k]
                keep = partial + reach >= floor - 1
                alive, partial = alive[keep], partial[keep]
        top = np.lexsort((self.ids[alive], -partial))[:k]
        return [(int(partial[i]), int(self.ids[alive[i]])) for i in top]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each row of ``queries``."""
    # Equal rows travel as one with their number.
    rows = quantized(vectors, vec_id, embedding, scale).groupBy("id", "q").agg(F.count("*").alias("n"))
    asked = quantized(queries, vec_id, embedding, scale).dropDuplicates(["id", "q"])
    n = quantized(vectors, vec_id, embedding, scale).count()
    row_blocks = max(1, math.ceil(n / min(ROWS, max(64, 4 * math.isqrt(n)))))
    query_blocks = max(1, math.ceil(asked.count() / QUERIES))
    block = lambda blocks: F.pmod(F.xxhash64("id", "q"), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    placed = rows.select(block(row_blocks).alias("row_block"), every(query_blocks).alias("query_block"), F.size("q").alias("dims"), "id", "q", "n")
    sent = asked.select(every(row_blocks).alias("row_block"), block(query_blocks).alias("query_block"), F.size("q").alias("dims"), "id", "q")

    def scan(key: tuple, candidates: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if candidates.num_rows and questions.num_rows:
            dims = candidates.column("dims")[0].as_py()
            matrix = lambda t: np.asarray(t.column("q").combine_chunks().flatten()).reshape(t.num_rows, dims) if dims else np.zeros((t.num_rows, 0), dtype=np.int64)
            rows, asks = matrix(candidates), matrix(questions)
            largest = max(int(np.abs(m.astype(np.float64)).max(initial=0)) for m in (rows, asks))
            ids, times = candidates.column("id").to_numpy(), candidates.column("n").to_numpy()
            again = np.repeat(np.arange(len(ids)), np.minimum(times, k))  # equal rows are candidates each
            block = Block(ids[again], rows[again], largest)
            for own, query in zip(questions.column("id").to_pylist(), asks):
                out += [(own, i, s) for s, i in block.best(own, query, k)]
        return pa.Table.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    groups = ("row_block", "query_block", "dims")
    found = placed.groupBy(*groups).cogroup(sent.groupBy(*groups)).applyInArrow(scan, "query_id long, vec_id long, score long")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("negative"), "vec_id"))), 1, k)
    top = found.groupBy("query_id").agg(best.alias("best"))
    return top.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", (-F.col("b.negative")).alias("score"))
