"""Queries over the test tables for the operators of this subpackage; the SQL of those that SQL can express is in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.distinctive import distinctive_terms
from tessera.llm.handwritten import not_handwritten
from tessera.llm.leaks import leaked_passages
from tessera.llm.markup import clean_markup
from tessera.llm.mixing import mixture
from tessera.llm.pii import redact_pii
from tessera.llm.rankwalk import lists_of, rank_walk
from tessera.llm.sentences import split_sentences
from tessera.llm.split import split_oversized
from tessera.runtime import table


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t: table(spark, d, t).select(F.lit(t).alias("source_table"), "row_id", "body")
    return part("gh_issue").unionByName(part("gh_comment"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks")).select("chunk_id", "file_path", "piece", "n_pieces", "byte_offset", "token_count", "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(table(spark, d, "chunks").select("chunk_id", "text", "byte_offset", "token_count"))
    return pieces.where(F.col("piece") == 1).select("chunk_id").distinct()


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "chunks")).select("file_path")


def _walked(spark: SparkSession, d: str) -> DataFrame:
    return rank_walk(lists_of(table(spark, d, "search_result"), table(spark, d, "display_result")))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _walked(spark, d).select("query_id", "chunk_id", "position", "stationarity")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    agreed = (F.col("n_lists") == F.col("query_lists")) & (F.col("worst_higher") < 5)
    return _walked(spark, d).where(agreed).select("query_id", "chunk_id")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Weights of all terms of all chunks, of any length and script."""
    return distinctive_terms(table(spark, d, "chunks"), min_length=1, unicode=True).select("chunk_id", "term", "tf", "df", F.round("score", 4).alias("score"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive_terms(table(spark, d, "chunks"), min_count=3, min_df=2, max_df=5).select("chunk_id", "term").distinct()


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_markup(_bodies(spark, d)).select("source_table", "row_id", "clean_text", "constructs")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return clean_markup(_bodies(spark, d), with_text=False).where(F.size("constructs") > 0).select("source_table", "row_id").distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_pii(_bodies(spark, d)).select("source_table", "row_id", "redacted", F.size("spans").alias("n_spans"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of the data's statement; payment cards are found too, but are no kind there."""
    found = redact_pii(_bodies(spark, d), with_text=False)
    kinds = found.select("source_table", "row_id", F.explode("spans.pii_type").alias("pii_type"))
    return kinds.where(F.col("pii_type").isin("email", "phone", "id_number", "address", "name")).distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and the most words of them in one."""
    pairs = leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_item"))
    per = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("most_words"))
    return table(spark, d, "eval_item").select("item_id", "suite").join(per, "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    draws, _ = mixture(table(spark, d, "documents"), table(spark, d, "source_target"))
    return draws.select("doc_id", "repeat", "source", "tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    _, shares = mixture(table(spark, d, "documents"), table(spark, d, "source_target"))
    return shares


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every document, whatever its format."""
    return split_sentences(table(spark, d, "documents"), keep=("doc_id", "format"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    plain = table(spark, d, "documents").where(F.col("format") == "plain")
    return split_sentences(plain).select("doc_id", "start_char", "end_char").distinct()


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p2_found, p2_files, p3_found, p3_ranking, p4_found, p4_terms, p5_found, p5_clean, p7_found, p7_redacted, p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_sentences)
}
