"""Exact nearest vectors by cosine or by sign bits: one pass, a bounded heap per task, no sort of the whole. A set of
queries runs against all vectors in blocks of bounded size, each a matrix product per batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.runtime import BROADCAST_BYTES


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<float>")


def cosine_topk(vectors: DataFrame, query: list[float], k: int | None, threshold: float | None = None, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """The k vectors of unit length with the largest dot product, and at least threshold; ties by key. All of them, in no
    order, if k is None."""
    scored = vectors.where(F.col(column).isNotNull()).withColumn("score", V.dot(F.col(column), literal(query)))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored if k is None else scored.orderBy(F.desc("score"), key).limit(k)


def hamming_topk(vectors: DataFrame, query: list[float], k: int | None, threshold: float | None = None, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """The same by the signs of the elements only."""
    words = [0] * ((len(query) + 63) // 64)
    for i, x in enumerate(query):
        if x > 0:
            words[i // 64] |= 1 << (i % 64)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    bits = F.lit(signed).cast("array<bigint>")
    scored = vectors.where(F.col(column).isNotNull()).withColumn("score", V.hamming_score(V.sign_words(F.col(column)), bits))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored if k is None else scored.orderBy(F.desc("score"), key).limit(k)


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, k: int, signs: bool) -> Iterator[pa.RecordBatch]:
    """(query, key, score): the k best of this task for each query, gathered batch by batch."""
    best_s, best_k = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
    dims = queries.shape[1]
    width = 64 * ((dims + 63) // 64)
    for b in batches:
        if not b.num_rows:
            continue
        keys, v = b.column(0).to_numpy(zero_copy_only=False), _unpacked(b.column(1), dims)
        if signs:
            a, q = (v > 0) * 1.0, (queries > 0) * 1.0
            differ = a.sum(1)[None, :] + q.sum(1)[:, None] - 2 * (q @ a.T)
            scores = 1 - 2 * differ / width
        else:
            scores = np.round(queries @ v.T, 12)  # equal vectors are to tie, wherever they stand in a matrix
        best_s = np.concatenate([best_s, scores], 1)
        best_k = np.concatenate([best_k, np.broadcast_to(keys, scores.shape)], 1)
        order = np.lexsort((best_k, -best_s), axis=1)[:, :k]
        best_s, best_k = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_k, order, 1)
    n = best_s.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_k.ravel()), pa.array(best_s.ravel())], ["query", "key", "score"])


def query_set_topk(vectors: DataFrame, queries: DataFrame, k: int, signs: bool = False, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """(query, key, score, rank from 0): for each row of queries (key, column) its k nearest rows of vectors, by the dot
    product or by signs, ties by key. Keys are whole numbers, vectors of one length; null vectors and keys are left out.

    The queries are taken in blocks of at most BROADCAST_BYTES, by the hash of their key; a block is one pass over all
    vectors, from which each task sends on k rows a query.
    """
    spark = vectors.sparkSession
    there = lambda df: df.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v"))
    ours, theirs = there(vectors), there(queries)
    n, dims = theirs.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    out = spark.createDataFrame([], "query long, key long, score double")
    blocks = max(1, -(-2 * n * 8 * (dims or 1) // BROADCAST_BYTES))
    for i in range(blocks if n else 0):
        block = theirs.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids, q = block.column("key").to_numpy(), _unpacked(block.column("v").combine_chunks(), dims)
        known = spark.sparkContext.broadcast((ids, q))
        out = out.unionByName(ours.where(F.size("v") == dims).mapInArrow(lambda it, known=known: _nearest(it, *known.value, k, signs), "query long, key long, score double"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key")) - 1)
    return ranked.where(F.col("rank") < k)
