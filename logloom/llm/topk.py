"""Exact top-k by inner product: branch and bound over a columnar (dimension-major) layout.

Vectors are quantised to integers and packed in blocks, dimension blocks outermost, in the smallest integers that hold
them. For some queries and a block of candidates the scores are accumulated one dimension block after another, those
dimensions first in which the queries are long. After each, what the rest can add at most is bounded by the lengths of the
remaining parts (Cauchy-Schwarz); candidates that cannot reach the k-th best score so far of any of these queries are dropped and the
survivors compacted. A task keeps the best k of each of its queries while it goes through its candidate blocks, those with
the longest vectors first, so the bounds sharpen.

Queries are joined with all candidates in blocks: a task takes one group of candidate blocks and one bucket of query
blocks. Blocks are copied to each task that needs them, so nothing is broadcast and no task meets all queries or all candidates.

Scores are sums of integers, exact while they stay below 2^53 in double precision (checked; beyond it they are summed
as 64-bit integers, so they must fit those). Defined results: vectors that are null, or hold null or non-finite components, take no part; a
vector of another length is no candidate; ties go to the smaller id; fewer than k candidates give all; rows that
repeat an id are candidates each, but never of their own id; an id that is asked with several vectors gets the k best of all
their scores (equal vectors count once); a null id takes no part; an empty vector scores 0 with
the others; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_workers

#: Dimensions that are accumulated at once, queries and candidates of a block, queries that candidates are dropped for together.
DIMENSIONS, QUERIES, CANDIDATES, TOGETHER = 16, 512, 4096, 32
#: Candidate blocks of a group and query blocks of a bucket, about.
GROUP_BLOCKS, BUCKET_BLOCKS = 4, 4

PACKED = "dim int, longest double, ids binary, kind string, matrix binary"


def small(matrix: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them; beyond 32 bits they stay doubles."""
    most = np.abs(matrix).max(initial=0)
    return matrix.astype(next((t for t, top in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if most <= top), "f8"))


def _packed(scale: float, rows: int):
    """Blocks of up to `rows` vectors of one length: ids, and floor(scale x) with dimensions outermost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            some = held.pop(dim)
            ids, matrix = np.array([x[0] for x in some], np.int64), np.array([x[1] for x in some], np.float64).reshape(len(some), dim)
            longest = float(np.sqrt((matrix**2).sum(1)).max(initial=0))
            packed = np.ascontiguousarray(small(matrix).T)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([longest]), pa.array([ids.tobytes()], pa.binary()), pa.array([packed.dtype.str]), pa.array([packed.tobytes()], pa.binary())], names=["dim", "longest", "ids", "kind", "matrix"])

        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("vector"), strict=True):
                v = x.values.to_numpy(zero_copy_only=False)
                if np.isfinite(v).all():
                    held.setdefault(len(v), []).append((i, np.floor(v * scale)))
                    if len(held[len(v)]) == rows:
                        yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return run


def unpacked(kind: str, matrix, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(matrix.as_buffer(), np.dtype(kind)).reshape(dim, rows).astype(np.float64)


def block_scores(queries: np.ndarray, candidates: np.ndarray, least: np.ndarray, alive_after: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of each pair that reaches the query's `least`, of matrices with dimensions outermost.

    A few more pairs may come, none of those is missing. alive_after: gets the number of candidates left after each dimension block but the last.
    """
    dim = len(queries)
    exact = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(dim, 1) < 2.0**53
    if not exact:
        total = queries.astype(np.int64).T @ candidates.astype(np.int64)
        least = least - np.abs(np.where(np.isfinite(least), least, 0)) * 1e-12  # it has been rounded
        q, c = np.nonzero(total >= least[:, None])
        return q, c, total[q, c]
    found = []
    for first in range(0, queries.shape[1], TOGETHER):
        own, own_least = queries[:, first : first + TOGETHER], least[first : first + TOGETHER]
        # The dimensions in which these queries are longest come first: what is left then bounds more.
        order = np.argsort(-(own**2).sum(1), kind="stable")
        own, alive = own[order], np.arange(candidates.shape[1])
        q_rest = np.sqrt(np.cumsum((own**2)[::-1], axis=0)[::-1])
        c_rest = np.sqrt(np.cumsum((candidates[order] ** 2)[::-1], axis=0)[::-1])
        total = np.zeros((own.shape[1], candidates.shape[1]))
        for at in range(0, dim, DIMENSIONS):
            some = candidates[order[at : at + DIMENSIONS]]
            total += own[at : at + DIMENSIONS].T @ (some if len(alive) == candidates.shape[1] else some[:, alive])
            if (to := at + DIMENSIONS) < dim and len(alive):
                # The sum of the lengths' product is rounded; the slack covers it.
                reach = total + q_rest[to][:, None] * c_rest[to, alive][None, :] * (1 + 1e-12) + 1e-6
                stay = (reach >= own_least[:, None]).any(0)
                if stay.mean() < 0.75:
                    alive, total = alive[stay], total[:, stay]
                if alive_after is not None:
                    alive_after.append(int(stay.sum()))
        q, c = np.nonzero(total >= own_least[:, None])
        found.append((q + first, alive[c], total[q, c].astype(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Best:
    """The k best (score, id) of each query of a block, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.of = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.least = np.full(len(ids), -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        own = self.ids[q] == ids
        q, ids, score = q[~own], ids[~own], score[~own]
        have = np.nonzero(self.of < np.iinfo(np.int64).max) if len(self.ids) else (np.zeros(0, int),) * 2
        q, ids, score = np.concatenate((have[0], q)), np.concatenate((self.of[have], ids)), np.concatenate((self.score[have], score))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.score[q[top], rank[top]], self.of[q[top], rank[top]] = score[top], ids[top]
        full = self.of[:, -1] < np.iinfo(np.int64).max
        self.least = np.where(full, self.score[:, -1].astype(float), -np.inf)

    def rows(self) -> pa.RecordBatch:
        q, r = np.nonzero(self.of < np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.of[q, r]), pa.array(self.score[q, r])], names=["query_id", "id", "score"])


def _searched(k: int):
    """Joined blocks, those of one query block in a row: the best of the candidates seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at, queries = None, None, None
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for row in range(batch.num_rows):
                block, dim = (columns["group"][row].as_py(), columns["block"][row].as_py()), columns["dim"][row].as_py()
                if block != at:
                    if best is not None:
                        yield best.rows()
                    at, best = block, Best(np.frombuffer(columns["q_ids"][row].as_buffer(), np.int64), k)
                    queries = unpacked(columns["q_kind"][row].as_py(), columns["q_matrix"][row], dim, len(best.ids))
                ids = np.frombuffer(columns["c_ids"][row].as_buffer(), np.int64)
                q, c, score = block_scores(queries, unpacked(columns["c_kind"][row].as_py(), columns["c_matrix"][row], dim, len(ids)), best.least)
                best.add(q, ids[c], score)
        if best is not None:
            yield best.rows()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the k candidates with the largest inner product of floor(scale x), for each query row.

    is_query: a condition on the id column, named `id`.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector"))
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    number = rows.agg(F.count("*").alias("all"), F.count_if(is_query).alias("asked")).first()
    groups, buckets = (max(1, -(-number[name] // size)) for name, size in (("all", CANDIDATES * GROUP_BLOCKS), ("asked", QUERIES * BUCKET_BLOCKS)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = rows.transform(in_workers, _packed(scale, CANDIDATES), PACKED)
    candidates = candidates.select("dim", F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("group"), every(buckets).alias("bucket"), "longest", F.col("ids").alias("c_ids"), F.col("kind").alias("c_kind"), F.col("matrix").alias("c_matrix"))
    # Queries are few: packed anew after a shuffle, so that their blocks are full.
    asked = rows.where(is_query).dropDuplicates(["id", "vector"]).transform(in_workers, _packed(scale, QUERIES), PACKED).withColumn("block", F.xxhash64("ids"))
    asked = asked.select("dim", every(groups).alias("group"), F.pmod("block", F.lit(buckets)).alias("bucket"), "block", F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("matrix").alias("q_matrix"))
    joined = candidates.join(asked, ["dim", "group", "bucket"]).sortWithinPartitions("group", "block", F.desc("longest"))
    found = joined.select("group", "block", "dim", "q_ids", "q_kind", "q_matrix", "c_ids", "c_kind", "c_matrix").transform(in_workers, _searched(k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
