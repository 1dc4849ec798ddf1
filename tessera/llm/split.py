"""Splitting oversized items at natural boundaries.

Bounded-quantifier regular expressions cut a text into cores: each alternative consumes up to the limit of tokens and
must end at one kind of boundary, the alternatives stand in the order of boundary strength, and the last one cuts
between any two units. The overlap is looked back from the core before, with array functions. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import sums_before

#: The ASCII blanks that separate tokens.
BLANKS = " \t\n\f\r"
_B = r" \t\n\f\r"
_TOKEN = rf"[^{_B}]++"
#: What must stand at the end of a core, strongest first. A chunk of code starts with its path in brackets.
_ENDS_PROSE = (
    rf"(?=[ \t\f\r]*+\n[ \t\f\r]*+\n)",  # blank line
    rf"(?<=[.!?…。！？؟।][\"'”’»」』)\]]{{0,3}})(?=[{_B}])",  # sentence
    rf"(?=[ \t\f\r]*+\n)",  # line
    rf"(?<=[,;:、，；،])(?=[{_B}])",  # clause
)
_ENDS_CODE = (
    rf"(?=[ \t\f\r]*+\n[ \t\f\r]*+\n)",  # blank line
    rf"(?=[ \t\f\r]*+\n[^{_B}])",  # line before an unindented one
    rf"(?=[ \t\f\r]*+\n)",  # line
    rf"(?<=[,;{{}}])(?=[{_B}])",  # statement or list item
)


def _units(least: int, most: int, end: str) -> str:
    """From least to most tokens, as many as possible, then end."""
    return rf"(?:{_TOKEN}[{_B}]*+){{{max(least, 1) - 1},{most - 1}}}{_TOKEN}{end}"


def _core(least: int, most: int, ends: tuple[str, ...]) -> str:
    whole = _units(1, most, rf"[{_B}]*+\z")
    return "|".join([whole, *(_units(least, most, e) for e in ends), rf"(?:{_TOKEN}[{_B}]*+){{1,{most}}}"])


def core_pattern(limit: int, overlap: int, code: bool) -> str:
    """The pattern whose matches, one after the other, are the cores of a text: up to limit tokens in the first, which
    repeats nothing, and limit - overlap in each later one. A core that another one follows has at least overlap tokens."""
    ends = _ENDS_CODE if code else _ENDS_PROSE
    rest = limit - overlap
    first, later = (_core(max(n // 2, overlap, 1), n, ends) for n in (limit, rest))
    return rf"\A[{_B}]*+(?:{first})|[{_B}]*+(?:{later})"


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{_B}]+"))


def split_oversized(chunks: DataFrame, limit: int = 512, overlap: int = 102, keep_small: bool = False) -> DataFrame:
    """Cut the chunks of more than limit tokens into pieces of at most limit tokens.

    A token is a maximal run of characters other than the ASCII blanks. Consecutive pieces share overlap tokens.
    Columns of chunks that the operator does not make pass through; made are piece (0-based), n_pieces, text,
    token_count (counted anew, the landed one is not read) and byte_offset: the landed offset plus the bytes of the
    chunk before the piece, the leading "[path] " of code chunks not counted, as it is not in the file (null if the
    landed offset is null). Only pieces of oversized chunks come out unless keep_small.

    Null, empty and blank texts have no piece. Repeated rows come out repeatedly. A text without blanks is one token.
    Colliding columns piece and n_pieces of the input are replaced.
    """
    if overlap < 0 or 3 * overlap > limit:
        raise ValueError("overlap must be from 0 to a third of the limit")
    df = chunks.drop("piece", "n_pieces")
    if not keep_small:  # so many tokens have as many characters and a blank between each two
        df = df.where(F.length("text") > 2 * limit)
    code = F.col("text").rlike(r"^\[[^\]\n]+\] ")
    cores = F.when(code, F.regexp_extract_all("text", F.lit(core_pattern(limit, overlap, True)), F.lit(0))).otherwise(
        F.regexp_extract_all("text", F.lit(core_pattern(limit, overlap, False)), F.lit(0))
    )
    df = df.withColumn("__cores", cores).where(F.size("__cores") > (0 if keep_small else 1))
    # pieces carry their core, the one before and where they begin; the text itself stays behind
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("__cores", F.lit(1), F.size("__cores") - 1))
    starts = sums_before(F.transform("__cores", lambda c: F.octet_length(c)))
    made = F.arrays_zip(F.col("__cores").alias("core"), before.alias("before"), starts.alias("start"))
    prefix = F.octet_length(F.regexp_extract("text", r"^(\[[^\]\n]+\] )", 1)).alias("__prefix")
    others = [c for c in df.columns if c not in ("__cores", "text", "token_count", "byte_offset")]
    keep = [F.col(f"`{c}`") for c in others]
    df = df.select(*keep, prefix, "byte_offset", F.size("__cores").alias("n_pieces"), F.posexplode(made).alias("piece", "__p"))
    tail = F.when(F.col("piece") == 0, F.lit("")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(F.col("__p.before"), F.lit(rf"{_TOKEN}[{_B}]*+"), F.lit(0)), -overlap, overlap) if overlap else F.array().cast("array<string>"), "")
    )
    df = df.withColumn("__tail", tail).withColumn("__full", F.concat("__tail", F.col("__p.core")))
    lead = F.octet_length("__full") - F.octet_length(F.ltrim("__full", F.lit(BLANKS)))
    inside = F.col("__p.start") - F.octet_length("__tail") + lead
    return df.select(
        *keep,
        "piece",
        "n_pieces",
        (F.col("byte_offset") + F.greatest(inside - F.col("__prefix"), F.lit(0))).cast("bigint").alias("byte_offset"),
        F.btrim("__full", F.lit(BLANKS)).alias("text"),
    ).withColumn("token_count", _count(F.col("text")))
