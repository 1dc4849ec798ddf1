"""Results as text and as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

FIELDS = ("score", "file_path", "byte_offset", "line_number", "text", "token_count")


def as_lines(results: DataFrame, context: int = 2) -> DataFrame:
    """(rank, shown): the printed form of each result."""
    head = F.concat(T.format_score(F.col("score")), F.lit("  "), T.shorten_path(F.col("file_path")), F.lit(":"), F.col("line_number").cast("string"), F.lit("\n"))
    return results.select("rank", F.concat(head, F.regexp_replace(T.preview(F.col("text"), context), "(?m)^", "  ")).alias("shown"))


def as_text(results: DataFrame, context: int = 2) -> str:
    return "\n\n".join(r["shown"] for r in as_lines(results, context).orderBy("rank").collect())  # top-k rows


def as_json(results: DataFrame) -> DataFrame:
    """One row with a pretty array of the results in rank order; none if there is no result."""
    rows = F.array_sort(F.collect_list(F.struct("rank", *[F.col(f) for f in FIELDS])))
    plain = F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in FIELDS]))
    return results.agg(plain.alias("r")).where(F.size("r") > 0).select(F.to_json("r", {"pretty": "true"}).alias("json"))
