"""Fusing two rankings and removing results that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.spec import MAX_PER_FILE, RRF_K


def ranked(df: DataFrame, by: str, key: str = "chunk_id") -> DataFrame:
    """(key, rank from 0) by a score; for lists that a limit has bounded, as the window is one partition."""
    return df.select(key, (F.row_number().over(Window.orderBy(F.desc(by), key)) - 1).alias("rank"))


def reciprocal_rank_fusion(lexical: DataFrame, neural: DataFrame, top: int, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(key, rrf, bm25_rank, neural_rank) of the best top of two (key, rank) lists; a missing rank counts as the sum of
    both lengths. Ties: the better lexical rank, then the neural one, then the key."""
    a, b = lexical.select(key, F.col("rank").alias("bm25_rank")), neural.select(key, F.col("rank").alias("neural_rank"))
    both = a.join(b, key, "full_outer")
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # bounded lists
    missing = F.count("bm25_rank").over(everything) + F.count("neural_rank").over(everything)
    of = lambda c: F.coalesce(F.col(c).cast("bigint"), missing)
    fused = both.select(key, of("bm25_rank").alias("r1"), of("neural_rank").alias("r2"), "bm25_rank", "neural_rank")
    fused = fused.withColumn("rrf", 1.0 / (k + F.col("r1")) + 1.0 / (k + F.col("r2")))
    return fused.orderBy(F.desc("rrf"), "r1", "r2", key).limit(top).select(key, "rrf", "r1", "r2", "bm25_rank", "neural_rank")


def restore_scores(fused: DataFrame, neural: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Of the fused list, the rows with a neural score, which they show; rank is their order (from 0)."""
    kept = fused.join(neural.select(key, "score"), key)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rrf"), "r1", "r2", key)) - 1)


def drop_overlaps(results: DataFrame, cap: int = MAX_PER_FILE) -> DataFrame:
    """At most two results per file (file_path, line_number, text, rank), best rank first, none overlapping one kept.

    With two, the second kept is the first that does not overlap the best; two windows per file say so.
    """
    if cap != 2:
        raise ValueError("the closed form holds for two results per file")
    lines = F.greatest(T.line_count(F.col("text")), F.lit(0))
    w = Window.partitionBy("file_path").orderBy("rank", "line_number")
    df = results.withColumn("__s", F.col("line_number")).withColumn("__e", F.col("line_number") + lines)
    df = df.withColumn("__n", F.row_number().over(w)).withColumn("__s0", F.first("__s").over(w)).withColumn("__e0", F.first("__e").over(w))
    df = df.where((F.col("__n") == 1) | ~((F.col("__s") < F.col("__e0")) & (F.col("__e") > F.col("__s0"))))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__s", "__e", "__n", "__s0", "__e0")
