"""Which files nobody in the project wrote by hand: generated, minified, vendored, or bulk data saved as code.

Four kinds of evidence are joined per file. Paths and the text of each chunk are judged by expressions in the JVM.
Copies that carry no mark are found by winnowing: the token stream of every chunk, normalised by folding case and
dropping layout, gives k-gram fingerprints; a file most of whose fingerprints recur in several unrelated repositories
(the first part of the path) is a vendored copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing as H
from tessera.runtime import written

# Folders and names that stand for files made elsewhere, and what tools write at the head of their output.
VENDOR_DIRS = "vendor vendors vendored third_party third-party thirdparty 3rdparty external externals extern deps node_modules bower_components site-packages jspm_packages Godeps Pods Carthage".split()
GENERATED_DIRS = "generated __generated__ generated-sources gen-src dist".split()
GENERATED_NAMES = (
    r"\.(?:g|gen|generated|designer|pb|pbobjc|freezed|min|bundle|bundled|compiled|packed)\.[a-z0-9]+$",
    r"_pb2(?:_grpc)?\.pyi?$",
    r"OuterClass\.java$",
    r"[._-](?:min|generated|autogen)\.[a-z0-9]+$",
    r"(?:^|/)(?:zz_generated|package-lock|yarn\.lock|pnpm-lock)[^/]*$",
)
PROSE = "md markdown txt text rst adoc org wiki".split()

#: What stands right after the comment sign: that a tool made the file, in the words of some languages.
_MADE = "(?:generated|written|produced|created|emitted|compiled|built)"
GENERATED_MARKS = (
    r"@generated\b",
    r"<auto-?generated\b",
    rf"(?:(?:code|file|this|source|content|class|module)[ ,:]*)?(?:this (?:file|code|class|module|source) )?(?:was |is |has been |were )?(?:auto(?:matically)?[- ]?|machine[- ]?|tool[- ]?)?{_MADE} (?:automatically )?(?:by|from|with|via|using|out of)\b(?! hand)",
    r"generated (?:\w+ ){1,4}(?:by|from|with|via|using)\b(?! hand)",
    rf"(?:automatically|auto|machine|tool)[- ]?{_MADE}\b",
    r"generated (?:file|code|source)s?\b[^\n]{0,40}(?:do not|don't)",
    r"generated (?:on|at) [^\n]{0,80}(?:edits|changes)",
    r"(?:please )?(?:do not|don't|never) (?:edit|modify|touch|change)(?: this file)?(?:,? by hand)?\s*[.!]*\s*(?:-->|\*/)?$",
    r"diese datei wurde (?:automatisch|maschinell)",
    r"(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)",
    r"(?:ce |le )?(?:fichier|code)?[ ]?(?:a été )?(?:généré|produit|créé)e? (?:automatiquement|par un outil)",
    r"(?:este )?(?:archivo|fichero|código)? ?(?:fue |ha sido )?(?:generado|creado|producido) (?:automáticamente|por una herramienta)",
    r"(?:этот )?(?:файл|код)? ?(?:создан|сгенерирован|сгенерировано)\S* автоматически|автоматически сгенерирован",
    r"(?:この|本)?ファイルは?自動(?:的に)?生成|自動生成|(?:此|本)?文件?由?[^\n]{0,20}自动生成|自动生成",
)
#: That it came from another project: said outright, or copied, with a sign of a project elsewhere on the line.
VENDORED_MARKS = (
    r"(?:vendored|bundled|mirrored)(?: \w+){0,2} (?:from|of)\b",
    r"(?:vendored|bundled|verbatim|unchanged|unmodified) copy of\b",
    r"third[- ]party (?:source|code|library|file|component|module)s?\b",
    r"(?:copied|imported|forked|taken|adapted|synced)(?: \w+){0,2} (?:from|of|at)\b[^\n]{0,120}(?:\bupstream\b|third[- ]party|https?://|\bv?\d+\.\d+)",
    r"copyright [^\n]{0,160}\bupstream\b",
)
BANNER = r"^/\*![ @]?[\w.@/-]+ v?\d+\.\d+"

_COMMENT = r"(?im)^[ \t]*(?:/\*+!?|\*+|//+!?|#+!?|--+|;+|%+|<!--|\"\"\"|''')[ \t\r\n*]*"
#: A literal of a table: number, short string, key of a pair.
_LITERAL = r"(?:0[xX][0-9a-fA-F]+[uUlL]{0,3}|[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?[fFuUlL]{0,3}|\"[^\"\\\n]{0,40}\"(?:\s*:)?|'[^'\\\n]{0,40}'(?:\s*:)?)[ \t]*[,\])}:]*[ \t]*"

#: A chunk is bulk data from so many literals on, if they are at least this part of its text.
DATA_LITERALS, DATA_PART = 60, 0.6
#: k-gram and window of the fingerprints, in tokens; repositories and part of a file's fingerprints that make a copy.
K, WINDOW, REPOS, PART = 16, 32, 3, 0.6
#: At most so many fingerprints are broadcast.
HEAVY = 10_000


def _any(patterns) -> str:
    return "(?:" + "|".join(patterns) + ")"


def _dirs(names) -> str:
    return r"(?:^|/)(?:" + "|".join(names) + r")/"


def path_kind(path: Column) -> Column:
    """vendored, generated, minified or null, from the path alone."""
    return (
        F.when(path.rlike("(?i)" + _dirs(VENDOR_DIRS)), "vendored")
        .when(path.rlike(r"(?i)[._-](?:min|packed|bundle)\.[a-z0-9]+$"), "minified")
        .when(path.rlike("(?i)" + _any(GENERATED_NAMES)) | path.rlike("(?i)" + _dirs(GENERATED_DIRS)), "generated")
    )


def is_source(path: Column) -> Column:
    return ~F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*PROSE)


def judged_chunks(chunks: DataFrame) -> DataFrame:
    """(file_path, kinds): generated, vendored, minified or data, for each chunk, from its path and from its text.

    What several rules read (the code without path and hard blanks, its first long line, the count of its digits and quotation marks) is
    computed once, in steps that stay apart in the plan."""
    path = F.col("file_path")
    bare = F.replace(F.regexp_replace("text", r"\A\[[^\]\n]+\] ", ""), F.lit("\u00a0"), F.lit(" "))
    df = chunks.where(path.isNotNull()).select("file_path", path_kind(path).alias("known"), "text")
    df = df.select("file_path", "known", F.when(is_source(path), bare).alias("code"))
    code = F.col("code")
    df = df.select("file_path", "known", "code", F.regexp_extract(code, r"(?m)^[^\n]{240,}", 0).alias("long_line"), F.regexp_count(code, F.lit(r"[0-9\"']")).alias("signs"))
    line, n = F.col("long_line"), F.length("long_line")
    marked = lambda marks: code.rlike(_COMMENT + _any(marks))
    ends, blanks = F.regexp_count(line, F.lit(r"[;{}]")), F.regexp_count(line, F.lit(r"[ \t]"))
    minified = (n >= 240) & (ends * 50 >= n) & (blanks * 8 <= n) & ~line.rlike(r"^[^;{}]{0,60}[\"'`][^\"'`]*$") & ~line.rlike(_COMMENT + r"\w+ \w+ \w+ ")
    # both alternatives hold a run of 40, wherever it begins; a ruler of signs is none
    packed = code.rlike(r"[A-Za-z0-9+/=]{40}") & code.rlike(r"(?![=/+]{40})[A-Za-z0-9+/=]{160}|(?:[A-Za-z0-9+/=]{40,}+(?:\\\r?\n|[\"'`][ \t]*[+,]?[ \t\r\n]*[\"'`])){3}")
    plain = F.regexp_replace(code, r"(?m)(?://|#)[^\n]*$|/\*[\s\S]*?\*/", "")
    literals = F.regexp_extract_all(plain, F.lit(_LITERAL), F.lit(0))
    covered = F.aggregate(literals, F.lit(0), lambda s, x: s + F.length(F.regexp_replace(x, r"\s", "")))
    # every literal has a digit or a quotation mark
    data = (F.col("signs") >= DATA_LITERALS) & (F.regexp_count(plain, F.lit(_LITERAL)) >= DATA_LITERALS) & (covered >= DATA_PART * F.length(F.regexp_replace(plain, r"\s", "")))
    kind = F.when(marked(GENERATED_MARKS), "generated").when(marked(VENDORED_MARKS), "vendored").when(code.rlike(BANNER) | minified, "minified").when(packed | data, "data")
    return df.select("file_path", F.array_compact(F.array("known", kind)).alias("kinds"))


_KINDS = H.byte_table(H.WORD, high=True)


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files, repos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        skip = batch.column(3).to_numpy(zero_copy_only=False)
        data, at = H.spaced_buffers(batch.column(2))
        for a, b in H.slices(at):
            buf = data[at[a] : at[b]]
            cuts = at[a : b + 1] - at[a]
            starts, _, h = H.tokens(buf, _KINDS)
            rows = np.searchsorted(cuts, starts, "right") - 1
            ok = starts - cuts[rows] >= skip[a:b][rows] if len(starts) else np.zeros(0, bool)
            h, rows = h[ok], rows[ok]
            g = H.kgrams(h, rows, k)
            at_g = H.winnow(g, w)
            if len(at_g):
                r = rows[at_g] + a
                yield pa.RecordBatch.from_arrays([pa.array(g[at_g].view(np.int64)), pa.array(files[r]), pa.array(repos[r])], ["fp", "file", "repo"])


def copied_files(chunks: DataFrame, k: int = K, w: int = WINDOW, min_repos: int = REPOS, part: float = PART) -> DataFrame:
    """(file_path hash, share): files of whose fingerprints at least part recur in min_repos or more repositories. Rows
    are one per fingerprint and file; those of a frequent fingerprint are spread, whether it is common to repositories
    or not. A file of fewer than k tokens a chunk has no fingerprint; prose, which quotes, is left out."""
    path = F.col("file_path")
    prefix = F.concat(F.lit("["), path, F.lit("] "))
    rows = chunks.where(path.isNotNull() & is_source(path)).select(
        F.xxhash64(path).alias("file"),
        F.xxhash64(F.regexp_extract(path, r"^\.?/*([^/]+)/", 1)).alias("repo"),
        "text",
        F.when(F.startswith("text", prefix), F.octet_length(prefix)).otherwise(0).alias("skip"),
    )
    marks = written(rows.mapInArrow(lambda it: _fingerprints(it, k, w), "fp long, file long, repo long").distinct())
    total = marks.count()
    spread = marks.groupBy("fp", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("fp").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    # fingerprints with a HEAVY-th of all rows or more are HEAVY at most: they are broadcast, and their rows spread evenly
    often = F.col("n") * HEAVY >= total
    known = written(spread.where(often | (F.col("repos") >= min_repos)).select("fp", (F.col("repos") >= min_repos).alias("common"), often.alias("often")))
    heavy = known.where("often").select("fp", F.col("common").alias("heavy"))
    light = known.where(~F.col("often") & F.col("common")).select(F.col("fp").alias("key"), F.lit(True).alias("light"))
    joined = marks.join(F.broadcast(heavy), "fp", "left").withColumn("key", F.when(F.col("heavy").isNull(), F.col("fp")).otherwise(F.xxhash64("file", "fp"))).join(light, "key", "left")
    return (
        joined.groupBy("file")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("heavy", "light", F.lit(False))).alias("hits"))
        .where(F.col("hits") >= part * F.col("n"))
        .select("file", (F.col("hits") / F.col("n")).alias("share"))
    )


def not_handwritten(chunks: DataFrame, **winnowing) -> DataFrame:
    """Files nobody wrote by hand: (file_path, kinds array<string>), one row per file.

    A file is listed as soon as its path or any of its chunks shows it. Null paths are left out, null and empty texts
    show nothing; repeated chunks change nothing; prose files are judged by path only.
    """
    path = F.col("file_path")
    # a filter on kinds would be pushed below the steps and have each of them evaluated again
    shown = judged_chunks(chunks).groupBy("file_path").agg(F.collect_set("kinds").alias("kinds")).select("file_path", F.flatten("kinds").alias("kinds")).where(F.size("kinds") > 0)
    copies = copied_files(chunks, **winnowing)
    named = chunks.where(path.isNotNull()).select("file_path", F.xxhash64(path).alias("file")).distinct()
    copied = named.join(copies, "file").select("file_path", F.array(F.lit("copied")).alias("kinds"))
    return shown.unionByName(copied).groupBy("file_path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
