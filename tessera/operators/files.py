"""Filters over files and their keyword score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.spec import MAX_FILE_BYTES, MAX_SCORED_FILES

# Extensions that are never searched, in lower case.
DENIED = (
    "png jpg jpeg gif ico svg bmp webp exe dll pdb obj lib so dylib zip gz tar 7z rar nupkg woff woff2 ttf eot otf mp3 mp4 avi mov wav "
    "pdf doc docx xls xlsx pptx lock map min snap pyc class"
).split()


def extension_filter(files: DataFrame) -> DataFrame:
    return files.where(~F.lower(T.extension(F.col("path"))).isin(*DENIED))


def size_filter(files: DataFrame) -> DataFrame:
    return files.where(F.col("length").between(1, MAX_FILE_BYTES))


def utf8_filter(files: DataFrame) -> DataFrame:
    """Of a binary content column, the rows that are valid UTF-8, as string."""
    return files.where(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("content", F.col("content").cast("string"))


def hidden_filter(files: DataFrame, root: str = "") -> DataFrame:
    """Without files that have a part beginning with a point below the root."""
    return files.where(~F.substring("path", len(root) + 1, 1 << 30).rlike(r"(?:^|/)\.[^/.]"))


def glob_filter(files: DataFrame, glob: str) -> DataFrame:
    """Base names that match the glob (* ? [..] and {a,b})."""
    return files.where(F.regexp_extract("path", r"([^/\\]*)$", 1).rlike(glob_pattern(glob)))


def glob_pattern(glob: str) -> str:
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            out += "[" + glob[i + 1 : j].replace("!", "^", 1 if glob[i + 1] == "!" else 0).replace("\\", "\\\\") + "]"
            i = j
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if not (c.isalnum() or c == "_") and c.isascii() else c
        i += 1
    return f"^{out}$"


def keyword_score(content: Column, terms: list[str]) -> Column:
    """How many of the terms the content holds, ASCII case ignored; a repeated term counts again."""
    low = T.ascii_lower(content)
    score = F.lit(0)
    for t in terms:
        score = score + F.contains(low, F.lit(t)).cast("int")
    return score


def score_files(files: DataFrame, terms: list[str], most: int = MAX_SCORED_FILES) -> DataFrame:
    """The most best files (path, content, score, file_rank from 0), by score and path, among those with any term."""
    scored = files.withColumn("score", keyword_score(F.col("content"), terms))
    best = scored.orderBy(F.desc("score"), "path").limit(most).where(F.col("score") > 0)  # below the limit the score would be evaluated twice
    return best.withColumn("file_rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")) - 1)  # most rows at most
