"""Files related to the best ones: by the types they name, by imports, by synonyms of the query, by common changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.spec import COCHANGE_LIMIT, COCHANGE_SOURCES, DISCOVERY_SOURCES, MAX_EXTRAS, MAX_FILE_BYTES, MIN_COCHANGE

# What a query is about, and the words that files about it are named by.
SYNONYMS: list[tuple[str, str]] = [
    ("race concurrent thread parallel deadlock", "lock mutex semaphore atomic synchronize"),
    ("notify notification alert", "email smtp push signal hub message"),
    ("background scheduled cron recurring", "job worker queue hangfire hosted"),
    ("auth login signin credential", "token jwt session identity oauth"),
    ("cache caching memoize", "redis memory invalidate expire ttl"),
    ("retry resilience fault", "polly backoff circuit fallback timeout"),
    ("database query persistence", "repository entity dbcontext migration sql"),
    ("endpoint route api", "controller handler middleware request"),
    ("upload file storage", "blob stream multipart bucket"),
    ("logging observability tracing", "logger serilog telemetry diagnostic monitor"),
    ("permission authorization access", "role policy claim authorize rbac"),
    ("validate validation", "validator fluent rule constraint"),
    ("test testing", "mock fixture assert xunit fake"),
    ("deploy deployment ci pipeline", "docker kubernetes helm release workflow"),
    ("encrypt encryption secret security", "cipher hash vault certificate tls"),
    ("webhook callback event", "subscribe publish dispatch listener handler"),
]


def query_synonyms(query: str) -> list[str]:
    """Words that go with the query and do not occur in it, each once, in the table's order."""
    q = query.lower()
    found = (w for triggers, terms in SYNONYMS if any(t in q for t in triggers.split()) for w in terms.split())
    return list(dict.fromkeys(w for w in found if w not in q))


def synonyms(queries: DataFrame, column: str = "query") -> DataFrame:
    """queries with one row per synonym, in the column synonym."""
    q = F.lower(F.col(column))
    table = F.array(*[F.struct(F.array(*map(F.lit, a.split())).alias("on"), F.array(*map(F.lit, b.split())).alias("words")) for a, b in SYNONYMS])
    hit = F.filter(table, lambda m: F.exists(m["on"], lambda t: F.contains(q, t)))
    found = F.array_distinct(F.filter(F.flatten(F.transform(hit, lambda m: m["words"])), lambda w: ~F.contains(q, w)))
    return queries.withColumn("synonym", F.explode(found))


def type_names(files: DataFrame) -> DataFrame:
    """(path, name): capitalised words of at least six bytes with a lower-case letter, each once per file."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([\p{IsAlphabetic}\p{N}_]+)"), F.lit(1)))
    kept = F.filter(found, lambda w: (F.octet_length(w) >= 6) & w.rlike(r"^\p{Lu}") & w.rlike(r"\p{Ll}"))
    return files.select("path", F.explode(kept).alias("name"))


def imports(files: DataFrame) -> DataFrame:
    """(path, name): the last part of what each import line names, at least four bytes; the first form that fits counts."""
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(r"^\s*(?:using|use|from|import) "))
    lines = lines.select("path", T.trim_space(F.col("line")).alias("t"))
    t = F.col("t")
    body = lambda n: F.regexp_extract(t, rf"^.{{{n}}}(.*);$", 1)
    path = F.trim(body(6))
    none = F.array().cast("array<string>")
    using = F.when(F.endswith(t, F.lit(";")) & ~F.startswith(path, F.lit("(")) & ~F.contains(path, F.lit("=")), F.array(F.element_at(F.split(path, r"\."), -1))).otherwise(none)
    use = F.when(F.endswith(t, F.lit(";")), F.array(F.regexp_replace(F.element_at(F.split(body(4), "::"), -1), r"^[^\p{IsAlphabetic}\p{N}_]+|[^\p{IsAlphabetic}\p{N}_]+$", ""))).otherwise(none)
    words = F.filter(F.split(t, f"[{T.SPACE}]+"), lambda w: (F.octet_length(w) >= 4) & ~w.isin("from", "import", "as") & w.rlike(r"^\p{IsAlphabetic}"))
    other = F.transform(words, lambda w: F.element_at(F.split(w, r"\."), -1))
    names = F.when(F.startswith(t, F.lit("using ")), using).when(F.startswith(t, F.lit("use ")), use).otherwise(other)
    return lines.select("path", F.explode(F.filter(names, lambda w: F.octet_length(w) >= 4)).alias("name"))


def cochanges(commits: DataFrame, paths: DataFrame, limit: int = COCHANGE_LIMIT, least: int = MIN_COCHANGE) -> DataFrame:
    """(path, n) of the paths that share commits with the given ones: how often, the limit most frequent, at least least
    times. commits is (commit, path), repeated rows counting as one; paths is (path)."""
    changed = commits.select("commit", F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "").alias("path")).distinct()
    wanted = paths.select(F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "").alias("path")).distinct()
    hit = changed.join(wanted, "path", "left_semi").select("commit").distinct()
    counts = changed.join(hit, "commit", "left_semi").join(wanted, "path", "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "path").limit(limit).where(F.col("n") >= least)


def related_paths(files: DataFrame, scored: DataFrame, query: str, commits: DataFrame | None = None, most: int = MAX_EXTRAS) -> list[str]:
    """Up to most further paths, in order: those whose stem a type or import of the best scored files names, whose stem
    contains a synonym, or that often change with the best. files is (path, length); scored bounds what it is compared
    with, and has its contents."""
    top = scored.where(F.col("file_rank") < DISCOVERY_SOURCES)
    long = lambda df, n: df.where(F.octet_length("name") >= n).select(F.lower("name").alias("stem"))
    terms = long(type_names(top), 10).unionByName(long(imports(top), 8)).distinct()
    rest = files.select("path", "length").join(scored.select("path"), "path", "left_anti").withColumn("stem", F.lower(T.file_stem(F.col("path"))))
    rest = rest.where((F.octet_length("stem") >= 4) & F.col("length").between(1, MAX_FILE_BYTES))
    named = rest.join(terms.withColumn("named", F.lit(True)), "stem", "left")
    hit = F.col("named").isNotNull()
    for s in query_synonyms(query):
        hit = hit | (F.contains("stem", F.lit(s)) & (F.octet_length("stem") > len(s.encode())))
    if commits is not None:
        best = scored.where(F.col("file_rank") < COCHANGE_SOURCES).select("path")
        for row in cochanges(commits, best).collect():  # COCHANGE_LIMIT rows at most
            hit = hit | F.endswith(F.replace("path", F.lit("\\"), F.lit("/")), F.lit(row["path"]))
    return [r["path"] for r in named.where(hit).select("path").orderBy("path").limit(most).collect()]


def discover(files: DataFrame, scored: DataFrame, query: str, commits: DataFrame | None = None, most: int = MAX_EXTRAS) -> DataFrame:
    """The related files (path, content), in path order. files is (path, content)."""
    found = related_paths(files.withColumn("length", F.octet_length("content").cast("bigint")), scored, query, commits, most)
    return files.where(F.col("path").isin(found)).select("path", "content").orderBy("path")
