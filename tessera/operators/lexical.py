"""BM25 over any text table. Collection statistics are one row; scores are one projection over the texts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.spec import BM25_B, BM25_K1


@dataclass(frozen=True)
class Bm25Stats:
    n: int
    average: float
    df: dict[str, int]

    def idf(self, term: str) -> float:
        df = self.df.get(term, 0)
        return math.log((self.n - df + 0.5) / (df + 0.5) + 1) if df else 0.0


def corpus_stats(docs: DataFrame, terms: list[str], text: str = "text") -> Bm25Stats:
    """Number and average length of the texts and, per distinct term, how many hold it: one pass, one row."""
    names = list(dict.fromkeys(terms))
    row = docs.agg(
        F.count(F.col(text)).alias("n"),
        F.avg(T.word_count(F.col(text))).alias("average"),
        *[F.count_if(T.has_any(F.col(text), [t])).alias(f"df{i}") for i, t in enumerate(names)],
    ).first()
    return Bm25Stats(row["n"], row["average"] or 0.0, {t: row[f"df{i}"] for i, t in enumerate(names)})


def bm25_scores(docs: DataFrame, terms: list[str], stats: Bm25Stats | None = None, text: str = "text", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """docs that hold any of the terms, with their bm25 (positive), the statistics being those of docs unless given.

    A term repeated in the query adds repeatedly, terms in no text add nothing; null texts have no score. Texts without
    any term are dropped by one search that stops at the first hit; lengths and frequencies are then computed once each.
    """
    stats = stats or corpus_stats(docs, terms, text)
    known = [t for t in dict.fromkeys(terms) if stats.df.get(t)]
    df = docs.where(T.has_any(F.col(text), known))
    df = df.withColumns({"__dl": T.word_count(F.col(text)).cast("double"), **{f"__tf{i}": T.term_frequency(F.col(text), t).cast("double") for i, t in enumerate(known)}})
    score = F.lit(0.0)
    for t in terms:
        if t in known:
            tf = F.col(f"__tf{known.index(t)}")
            score = score + F.lit(stats.idf(t)) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("__dl") / F.lit(stats.average)))
    return df.withColumn("bm25", score).drop("__dl", *[f"__tf{i}" for i in range(len(known))])


def bm25_topk(docs: DataFrame, terms: list[str], k: int, key: str = "chunk_id", stats: Bm25Stats | None = None, text: str = "text") -> DataFrame:
    return bm25_scores(docs, terms, stats, text).orderBy(F.desc("bm25"), key).limit(k)


def candidates(chunks: DataFrame, words: list[str], terms: list[str], budget: int) -> DataFrame:
    """The chunks worth embedding: all of them if they are at most budget or if none scores; else the budget best by
    BM25, and behind them, in chunk order, up to half as many others whose path holds a term."""
    stats = corpus_stats(chunks, words)
    if stats.n <= budget or not any(stats.df.values()):
        return chunks
    best = bm25_topk(chunks, words, budget, stats=stats).drop("bm25")
    low = F.lower("file_path")
    in_path = F.lit(False)
    for t in terms:
        in_path = in_path | F.contains(low, F.lit(t))
    ids = best.select("chunk_id")  # budget rows at most
    boosted = chunks.where(in_path).join(F.broadcast(ids), "chunk_id", "left_anti").orderBy("chunk_id").limit(budget // 2)
    return best.unionByName(boosted)
