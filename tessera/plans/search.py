"""The whole search as one plan: score files, chunk the best, filter lexically, embed, fuse, thin out."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import chunking, discovery, embed, fusion, lexical, vector
from tessera.operators import files as files_op
from tessera.runtime import counted, ready, written
from tessera.runtime import observed as count_seen
from tessera.spec import SearchSpec

RESULT = ("rank", "score", "chunk_id", "file_path", "byte_offset", "line_number", "text", "token_count")


def number_chunks(chunks: DataFrame) -> tuple[DataFrame, int]:
    """chunk_id from 0 in file order, then place: the chunks of the files before, one count per file, plus the ordinal;
    and how many there are. Only the counts, one row for each of a bounded number of files, meet in a window."""
    chunks, n = counted(chunks)
    counts = chunks.groupBy("file_rank").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("file_rank", F.coalesce(F.sum("n").over(Window.orderBy("file_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    df = chunks.join(F.broadcast(before), "file_rank").withColumn("chunk_id", (F.col("__before") + F.col("ordinal")).cast("bigint"))
    return df.select("chunk_id", F.col("path").alias("file_path"), *[c for c in chunks.columns if c not in ("chunk_id", "path", "ordinal", "length", "score")]), n


def select_files(files: DataFrame, spec: SearchSpec, commits: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(path, content, file_rank): the best files by keyword and behind them the related ones; and how many scored. The
    texts are read once for the score; the related files are sought among paths and lengths, and only theirs read again."""
    searched = files if spec.glob is None else files_op.glob_filter(files, spec.glob)
    scored, n = counted(files_op.score_files(files_op.size_filter(files_op.extension_filter(searched)), spec.terms).select("path", "content", "file_rank"))
    related = discovery.related_paths(searched, scored, spec.query, commits) if n else []
    if not related:
        return scored, n
    rank = F.array_position(F.array(*map(F.lit, related)), F.col("path")).cast("int") - 1 + n
    extra = written(searched.where(F.col("path").isin(related)).select("path", "content", rank.alias("file_rank")))
    return scored.unionByName(extra), n


def rank_chunks(chunks: DataFrame, spec: SearchSpec, query_vector: list[float] | None = None, model_dir: str | None = None, observed: dict | None = None) -> DataFrame:
    """Results of a chunk table (chunk_id, file_path, byte_offset, line_number, text, token_count and, if query_vector is
    given, embedding). Fewer than top come out where files repeat or chunks overlap."""
    found = lexical.candidates(chunks, spec.words, spec.terms, spec.budget)
    if query_vector is None:
        found = embed.embed(found, model_dir=model_dir)
        query_vector = embed.embed_query(spec.query, model_dir)
    found, n = counted(found)  # read by both rankings and for the result
    if observed is not None:
        observed["embedded"] = n
    search = vector.hamming_topk if spec.fast else vector.cosine_topk
    neural = search(found, query_vector, 3 * spec.top, spec.threshold).select("chunk_id", "score")
    lexical_list = fusion.ranked(lexical.bm25_scores(found, spec.words).select("chunk_id", "bm25"), "bm25")
    fused = fusion.reciprocal_rank_fusion(lexical_list, fusion.ranked(neural, "score"), 2 * spec.top)
    shown = fusion.restore_scores(fused, neural).join(found, "chunk_id")
    return fusion.drop_overlaps(shown).orderBy("rank").limit(spec.top).select(*RESULT)


class SearchEngine:
    """Ad-hoc search over any (path, content) table, without an index."""

    def __init__(self, spark: SparkSession, model_dir: str | None = None) -> None:
        ready(spark)
        self.spark, self.model_dir = spark, model_dir
        self.stats: dict[str, float] = {}

    def search(self, files: DataFrame, spec: SearchSpec, commits: DataFrame | None = None) -> DataFrame:
        """files: path, content, and length in bytes (made if missing). What the run did is in stats afterwards."""
        began = time.time()
        if "length" not in files.columns:
            files = files.withColumn("length", F.octet_length("content").cast("bigint"))
        seen = Observation()
        passed = files.where(F.col("content").isNotNull())
        first = passed.observe(seen, F.count(F.lit(1)).alias("n"))
        chosen, scored = select_files(first, spec, commits)
        chosen_at = time.time()
        chunks, n_chunks = number_chunks(chunking.chunk_files(chosen, spec.chunk_size, spec.overlap))
        self.stats = {"seen": count_seen(seen), "scored": scored, "chunks": n_chunks}
        result = rank_chunks(chunks, spec, model_dir=self.model_dir, observed=self.stats)
        self.stats |= {"select_s": round(chosen_at - began, 3), "rank_s": round(time.time() - chosen_at, 3)}
        return result
