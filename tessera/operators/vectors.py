"""Exact nearest neighbours by cosine, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries compared at once in a task.
BLOCK = 64
#: Queries and vectors of a block.
QUERIES = 20_000
VECTORS = 50_000
#: With few vectors, parts of so many are enough work for a task.
FEW = 2_000


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query_id, vec_id, score, rank of each query's k nearest other vectors; ties (scores rounded to digits) by vec_id.

    Queries and vectors are dealt by hash into parts of bounded size, and each pair of parts is a block that meets in a shuffle; nothing passes the
    driver. A block gives k rows for each query, so what meets at a query is k times the number of parts, not the number of vectors."""
    asked = queries.filter("embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), "embedding")
    against = vectors.filter("embedding IS NOT NULL").select("vec_id", "embedding")
    n_vectors = against.count()
    n_left = max(1, -(-asked.count() // QUERIES))
    n_right = max(1, -(-n_vectors // VECTORS), min(64, -(-n_vectors // FEW)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(n_left)).cast("int").alias("a"), every(n_right).alias("b"))
    right = against.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(n_right)).cast("int").alias("b"), every(n_left).alias("a"))
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_best_of_block(k, digits), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best_of_block(k: int, digits: int):
    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return unit(np.array(flat, "f8").reshape(t.num_rows, -1))

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        q, v, s = [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0)]
        if queries.num_rows and vectors.num_rows:
            ids, vec = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
            asked, x = matrix(queries), matrix(vectors)
            for at in range(0, len(ids), BLOCK):
                score = np.round(asked[at : at + BLOCK] @ x.T, digits)
                score[ids[at : at + BLOCK][:, None] == vec[None, :]] = -2
                for i, row in enumerate(score):
                    best = np.lexsort((vec, -row))[:k] if len(vec) <= 4 * k else _top(row, vec, k)
                    best = best[row[best] >= -1]
                    q.append(np.full(len(best), ids[at + i]))
                    v.append(vec[best])
                    s.append(row[best])
        return pa.table({"query_id": np.concatenate(q), "vec_id": np.concatenate(v), "score": np.concatenate(s)})

    return run


def _top(row: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    least = np.partition(row, len(row) - k)[len(row) - k]
    near = np.nonzero(row >= least)[0]
    return near[np.lexsort((vec[near], -row[near]))[:k]]
