"""Queries over the test tables, one or more per operator; their SQL is in oracle.py. Documents stand for files:
path source/lang/doc_id.md, content text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunking, discovery, files, fusion, lexical, sync, vector
from tessera.operators.incremental import VersionedTarget, item_versions, pending_items, rendered_versions, run_incremental, saved_watermarks
from tessera.plans.search import SearchEngine, number_chunks, rank_chunks
from tessera.runtime import table, temporary
from tessera.schemas import GH_ISSUE
from tessera.sources import results
from tessera.sources.files import with_synced
from tessera.spec import SearchSpec
from tessera.spec import candidate_budget as spec_budget

QUERIES: dict = {}
WORDS = ["cache", "limit", "window"]
QUESTION = "cache limit of the window"
SEARCH = SearchSpec("cache limit window", top=10, chunk_size=64)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _files(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c), F.lit("none"))
    path = F.concat(some("source"), F.lit("/"), some("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", path.alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.col("text").alias("content"))


def _code_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as files: path and length only, or with content."""
    return table(spark, d, "chunks").select("chunk_id", F.col("file_path").alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.col("text").alias("content"))


def _vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == 0).select("embedding").first()[0]]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return sync.latest_items(table(spark, d, "gh_issue"), ["repo", "number"], tie="row_id")


# files


@query
def file_scan_filter(spark, d):
    kept = files.size_filter(files.extension_filter(_code_files(spark, d)))
    return kept.select("chunk_id", "path", "length")


@query
def glob_filter(spark, d):
    return files.glob_filter(_code_files(spark, d), "*_*.{py,rs}").select("chunk_id", "path")


@query
def hidden_filter(spark, d):
    return files.hidden_filter(_files(spark, d).withColumn("path", F.concat(F.lit("r/"), F.when(F.col("doc_id") % 3 == 0, ".x/").otherwise("x/"), "path")), "r/").select("doc_id", "path")


@query
def path_parts(spark, d):
    p = F.col("file_path")
    return table(spark, d, "chunks").select("file_path", T.file_stem(p).alias("stem"), T.extension(p).alias("ext")).distinct()


@query
def keyword_file_score(spark, d):
    return files.score_files(_files(spark, d), WORDS).select("path", "score", "file_rank")


@query
def literal_boost_score(spark, d):
    return files.score_files(_files(spark, d), SearchSpec(QUESTION, literals=("when the",)).terms).select("path", "score", "file_rank")


@query
def synced_union(spark, d):
    """Files and, behind them, the Markdown of synced items."""
    synced = table(spark, d, "manifest_entry").select(F.concat(F.lit("/data/sources/github/"), "repo", F.lit("/"), "path").alias("path"))
    return with_synced(_files(spark, d).select("path"), synced, ["/work/src"])


@query
def line_numbers(spark, d):
    """The line on which a word first stands, from its byte offset."""
    at = F.octet_length(F.substring_index("content", "cache", 1))
    return _files(spark, d).where(F.contains("content", F.lit("cache"))).select("doc_id", at.alias("byte_offset"), T.line_of_offset(F.col("content"), at).alias("line"))


@query
def run_statistics(spark, d):
    """What a search reports of itself: files seen, files scored, chunks made and chunks let through. The files bear the
    extension of no language, so that the sliding window cuts them."""
    seen = _files(spark, d).select(F.regexp_replace("path", r"\.md$", ".log").alias("path"), "length", "content")
    engine = SearchEngine(spark)
    engine.search(seen, SearchSpec("cache limit window", chunk_size=64, top=10))
    return spark.createDataFrame([(k, int(engine.stats[k])) for k in ("seen", "scored", "chunks", "embedded")], "what string, n bigint")


# queries


@query
def query_terms(spark, d):
    return table(spark, d, "gh_issue").select("row_id", F.posexplode(T.words(F.col("title"))).alias("pos", "term"))


@query
def candidate_budget(spark, d):
    n = F.size(T.words(F.col("title")))
    budget = F.get(F.array(*[F.lit(spec_budget(i, 10)) for i in range(6)]), F.least(n, F.lit(5)))  # from five terms on it is the same
    return table(spark, d, "gh_issue").where(F.col("title").isNotNull()).select("row_id", n.alias("n_terms"), budget.alias("budget"))


@query
def synonyms(spark, d):
    return discovery.synonyms(table(spark, d, "gh_issue").select("row_id", F.col("body").alias("query"))).select("row_id", "synonym")


# chunkers


@query
def naive_chunks(spark, d):
    return chunking.sliding_window(_files(spark, d)).select("path", "ordinal", "byte_offset", "line_number", "text", "token_count")


@query
def naive_chunks_small(spark, d):
    """Windows that span several strides."""
    return chunking.sliding_window(_files(spark, d), 40, 0.8).select("path", "ordinal", "byte_offset", "line_number", "token_count", F.md5("text").alias("text_md5"))


@query
def prose_chunks(spark, d):
    return chunking.prose_chunks(_files(spark, d)).select("path", "ordinal", "byte_offset", "line_number", "text", "token_count")


@query
def code_chunks(spark, d):
    source = _code_files(spark, d).withColumn("content", F.regexp_replace("content", r"\A\[[^\]\n]+\] ", ""))
    return chunking.code_chunks(source).select("chunk_id", "path", "ordinal", "byte_offset", "line_number", "text", "token_count")


@query
def dispatched_chunks(spark, d):
    return chunking.chunk_files(_code_files(spark, d).where(F.col("content").isNotNull())).select("chunk_id", "path", "ordinal", "byte_offset", "line_number", "token_count")


# lexical scoring


@query
def doc_length(spark, d):
    return _files(spark, d).select("doc_id", T.word_count(F.col("content")).alias("dl"))


@query
def average_length(spark, d):
    return _files(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(T.word_count(F.col("content"))), 6).alias("avgdl"))


@query
def term_freq(spark, d):
    return _files(spark, d).select("doc_id", *[T.term_frequency(F.col("content"), w).alias(f"tf_{w}") for w in WORDS])


@query
def doc_freq(spark, d):
    stats = lexical.corpus_stats(_files(spark, d).select(F.col("content").alias("text")), WORDS)
    row = (stats.n, *[stats.df[w] for w in WORDS], *[round(stats.idf(w), 6) for w in WORDS])
    return spark.createDataFrame([row], ", ".join(["n bigint", *[f"df_{w} bigint" for w in WORDS], *[f"idf_{w} double" for w in WORDS]]))


@query
def bm25_topk(spark, d):
    docs = _files(spark, d).select("doc_id", F.col("content").alias("text"))
    return lexical.bm25_topk(docs, WORDS, 50, "doc_id").select("doc_id", F.round("bm25", 4).alias("score"))


@query
def bm25_repeated_terms(spark, d):
    docs = _files(spark, d).select("doc_id", F.col("content").alias("text"))
    return lexical.bm25_scores(docs, ["cache", "cache", "limit"]).select("doc_id", F.round("bm25", 4).alias("score"))


def _doc_chunks(spark, d, size=64):
    """Sliding windows of the best files by keyword, numbered."""
    scored = files.score_files(_files(spark, d), WORDS)
    return number_chunks(chunking.sliding_window(scored, size))[0]


@query
def bm25_chunks_topk(spark, d):
    return lexical.bm25_topk(_doc_chunks(spark, d), WORDS, 50).select("chunk_id", F.round("bm25", 4).alias("score"))


@query
def candidates_with_path_boost(spark, d):
    return lexical.candidates(_doc_chunks(spark, d), WORDS, [*WORDS, "docs_site/es"], 50).select("chunk_id", "file_path")


@query
def bm25_rerank(spark, d):
    """Scores among the candidates, whose statistics are their own."""
    found = lexical.candidates(_doc_chunks(spark, d), WORDS, WORDS, 50)
    return lexical.bm25_scores(found, WORDS).select("chunk_id", F.round("bm25", 4).alias("score"))


# vectors


@query
def cosine_topk(spark, d):
    return vector.cosine_topk(_vectors(spark, d), _vector(spark, d), 20).select("chunk_id", F.round("score", 4).alias("score"))


@query
def cosine_threshold(spark, d):
    return vector.cosine_topk(_vectors(spark, d), _vector(spark, d), None, 0.25).select("chunk_id", F.round("score", 4).alias("score"))


@query
def cosine_query_set(spark, d):
    """Every vector whose id is divisible by 100 against all vectors."""
    v = _vectors(spark, d)
    found = vector.query_set_topk(v, v.where(F.col("chunk_id") % 100 == 0), 10)
    return found.select("query", F.col("key").alias("chunk_id"), "rank", F.round("score", 4).alias("score"))


@query
def hamming_query_set(spark, d):
    v = _vectors(spark, d)
    found = vector.query_set_topk(v, v.where(F.col("chunk_id") % 100 == 0), 10, signs=True)
    return found.select("query", F.col("key").alias("chunk_id"), "rank", F.round("score", 4).alias("score"))


@query
def sign_bits(spark, d):
    words = V.sign_words(F.col("embedding"))
    return _vectors(spark, d).select("chunk_id", F.size(words).alias("n_words"), F.get(words, 0).alias("word"))


@query
def hamming_topk(spark, d):
    return vector.hamming_topk(_vectors(spark, d), _vector(spark, d), 20).select("chunk_id", F.round("score", 4).alias("score"))


@query
def l2_norm(spark, d):
    e = F.col("embedding")
    twice = F.transform(e, lambda x: x * 2)
    return _vectors(spark, d).select("chunk_id", F.round(V.norm(twice), 4).alias("norm"), F.round(V.norm(V.normalise(twice)), 4).alias("unit"))


@query
def mean_pooling(spark, d):
    hidden = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.array(*[F.lit(i % 2) for i in range(8)])
    pooled = V.mean_pool(F.col("hidden"), F.col("mask"))
    return _vectors(spark, d).select("chunk_id", hidden.alias("hidden"), mask.alias("mask")).select("chunk_id", F.posexplode(pooled).alias("dim", "v")).select("chunk_id", "dim", F.round("v", 5).alias("v"))


# fusion


def _two_lists(spark, d):
    docs = _files(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("content").alias("text"))
    return lexical.bm25_topk(docs, WORDS, 100).select("chunk_id", "bm25"), vector.cosine_topk(_vectors(spark, d), _vector(spark, d), 100).select("chunk_id", "score")


@query
def rrf_fusion(spark, d):
    a, b = _two_lists(spark, d)
    fused = fusion.reciprocal_rank_fusion(fusion.ranked(a, "bm25"), fusion.ranked(b, "score"), 80)
    return fused.select("chunk_id", F.round("rrf", 8).alias("rrf"), "bm25_rank", "neural_rank")


@query
def rrf_restored(spark, d):
    a, b = _two_lists(spark, d)
    fused = fusion.reciprocal_rank_fusion(fusion.ranked(a, "bm25"), fusion.ranked(b, "score"), 80)
    return fusion.restore_scores(fused, b).select("chunk_id", "rank", F.round("score", 4).alias("score"))


@query
def dedup_overlap(spark, d):
    found = lexical.bm25_topk(_doc_chunks(spark, d), WORDS, 300)
    found = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bm25"), "chunk_id")) - 1)
    return fusion.drop_overlaps(found).select("chunk_id", "file_path", "rank")


# the whole search


@query
def hybrid_search(spark, d):
    """Over the sliding windows of the best files, with the vector of the document for each of its chunks."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = _doc_chunks(spark, d).join(vectors, "doc_id", "left")
    return rank_chunks(chunks, SEARCH, _vector(spark, d)).select("rank", F.round("score", 4).alias("score"), "chunk_id", "file_path", "byte_offset", "line_number", "text", "token_count")


@query
def search_files(spark, d):
    """The same from file selection and discovery on, with the chunkers by extension and hashed vectors."""
    return SearchEngine(spark).search(_files(spark, d).select("path", "length", "content"), SearchSpec(QUESTION, top=10))


@query
def search_files_fast(spark, d):
    return SearchEngine(spark).search(_files(spark, d).select("path", "length", "content"), SearchSpec(QUESTION, top=10, fast=True, literals=("overlap",)))


# discovery


@query
def type_names(spark, d):
    return discovery.type_names(_files(spark, d))


@query
def imports(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    lines = F.concat(
        F.lit("using "), name, F.lit(";\nusing (x = y."), name, F.lit(");\n  use "), F.replace("p_type", F.lit(" "), F.lit("::")), F.lit("::"), F.lit("Kind"), F.col("p_size").cast("string"), F.lit(";\r\nfrom "), name,
        F.lit(" import "), F.col("p_brand"), F.lit(" as x\nimport {A} from pkg."), name, F.lit("\nuse nothing"),
    )
    return discovery.imports(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), lines.alias("content")))


@query
def cochange(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit"), F.col("l_partkey").cast("string").alias("path"))
    best = items.groupBy("path").count().orderBy(F.desc("count"), "path").limit(20).select("path")
    return discovery.cochanges(items, best)


@query
def discovery_union(spark, d):
    """The best files and those they do not include but name; a file's stem is the first compound name in its text."""
    name = F.regexp_extract("content", "[A-Z][a-z]+[A-Z][a-z]+", 0)
    every = _files(spark, d).select(F.concat(F.lit("f/"), F.col("doc_id").cast("string"), F.lit("/"), F.when(name == "", F.lit("none")).otherwise(name), F.lit(".md")).alias("path"), "length", "content")
    scored = files.score_files(every, ["cache", "limit"])
    related = discovery.related_paths(every, scored, "caching of the walker")
    return scored.select("path").unionByName(spark.createDataFrame([(p,) for p in related], "path string"))


# items


@query
def slugify(spark, d):
    return table(spark, d, "gh_issue").select("row_id", T.slugify(F.col("title")).alias("slug"))


@query
def escape_yaml(spark, d):
    return table(spark, d, "gh_comment").select("row_id", T.escape_yaml(F.col("body")).alias("escaped"))


@query
def kind_filter(spark, d):
    return sync.kind_filter(table(spark, d, "gh_issue"), "prs").select("row_id", "number")


@query
def issues_filtered(spark, d):
    found = sync.since_filter(sync.state_filter(sync.kind_filter(table(spark, d, "gh_issue"), "issues"), "open"), "2025-01-01T00:00:00Z")
    return found.select("row_id", "repo", "number", "updated_at")


@query
def issues_limited(spark, d):
    return sync.first_items(_latest(spark, d).where(F.col("updated_at").isNotNull()), 100, ["repo", "number"]).select("repo", "number", "updated_at")


@query
def labels_filter(spark, d):
    return sync.label_filter(table(spark, d, "gh_issue"), ["bug"]).select("row_id")


@query
def sync_watermark(spark, d):
    return sync.watermark(table(spark, d, "gh_issue"))


@query
def incremental_upsert(spark, d):
    return _latest(spark, d).select("repo", "number", "row_id", "updated_at")


@query
def render_issue(spark, d):
    return sync.rendered(_latest(spark, d), table(spark, d, "gh_comment"), ["repo", "number"]).select("repo", "number", "kind", "path", "markdown")


@query
def render_without_comments(spark, d):
    return sync.rendered(_latest(spark, d), table(spark, d, "gh_comment"), ["repo", "number"], "none").select("repo", "number", F.md5("markdown").alias("md5"))


@query
def comments_joined(spark, d):
    """How many comments each item shows, and when the last one was made."""
    df = sync.with_comments(_latest(spark, d), table(spark, d, "gh_comment"), ["repo", "number"])
    return df.select("repo", "number", F.size("comments").alias("n_comments"), F.array_max(F.col("comments.created_at")).alias("last_comment"))


@query
def titles_truncated(spark, d):
    return table(spark, d, "gh_issue").select("row_id", T.truncate(F.col("title")).alias("title"))


@query
def json_round_trip(spark, d):
    """Issues written as JSON and read with the schema: logins, labels and what is null."""
    columns = "number title body state user assignees labels created_at updated_at html_url pull_request".split()
    back = F.from_json(F.to_json(F.struct(*columns)), GH_ISSUE)
    df = table(spark, d, "gh_issue").select("row_id", back.alias("x"))
    labels = F.array_join(F.coalesce(F.col("x.labels.name"), F.array().cast("array<string>")), ",")
    return df.select("row_id", "x.number", "x.title", F.col("x.user.login").alias("login"), labels.alias("labels"), F.col("x.pull_request").isNotNull().alias("is_pr"), "x.updated_at")


@query
def manifest(spark, d):
    return sync.manifest_summary(table(spark, d, "manifest_entry"))


@query
def manifest_lines(spark, d):
    """The entries of the manifest file."""
    return sync.manifest_lines(table(spark, d, "manifest_entry")).select("repo", "line")


@query
def manifest_header(spark, d):
    head = sync.manifest_header(table(spark, d, "manifest_entry"), "o", "r", "prs, issues")
    return head.withColumn("included_kinds", F.array_join("included_kinds", ","))


@query
def shorten_path(spark, d):
    root = F.when(F.col("number") % 2 == 0, "/home/u/sources/github/").otherwise("C:\\u\\sources\\github\\")
    full = F.concat(root, "repo", F.lit("/"), "path")
    return table(spark, d, "manifest_entry").select(full.alias("full_path"), T.shorten_path(full).alias("shown")).distinct()


@query
def parse_repo_url(spark, d):
    n = F.col("number") % 5
    url = F.concat(
        F.when(n == 0, "git@github.com:").when(n == 1, "https://github.com/").when(n == 2, "ssh://git@github.com/").when(n == 3, "http://github.com/").otherwise("https://forge.example/"),
        "repo",
        F.when(n == 1, ".git").when(n == 2, "/").when(n == 0, ".git.git").otherwise(""),
    )
    parsed = T.remote_repo(url)
    return table(spark, d, "gh_issue").select("row_id", url.alias("url"), parsed["owner"].alias("owner"), parsed["repo"].alias("name"))


@query
def parse_repo_argument(spark, d):
    parsed = T.repo_argument(F.col("repo"))
    return table(spark, d, "gh_issue").select("row_id", parsed["owner"].alias("owner"), parsed["repo"].alias("name"))


# output


@query
def preview(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.preview(F.col("text")).alias("shown"))


@query
def result_lines(spark, d):
    """The printed form of results; each stands for itself, under a rank of its own."""
    shown = table(spark, d, "display_result").where(F.col("text").isNotNull())
    return results.as_lines(shown.withColumn("rank", F.concat_ws("/", "query_id", "engine", "chunk_id", F.col("score").cast("double")))).select("rank", "shown").distinct()


@query
def json_output(spark, d):
    return results.as_json(hybrid_search(spark, d))


# incremental processing


@query
def p6_found(spark, d):
    return pending_items(table(spark, d, "gh_issue"), table(spark, d, "manifest_entry")).select("repo", "number")


@query
def p6_pending(spark, d):
    """The same with versions and reasons."""
    return pending_items(table(spark, d, "gh_issue"), table(spark, d, "manifest_entry"))


@query
def p6_watermarks(spark, d):
    return saved_watermarks(table(spark, d, "sync_state")).select("repo", "last_sync_ms")


@query
def p6_published(spark, d):
    """Two runs over the same source into a published target that holds what the manifest says earlier runs wrote: the
    items that each run did. The first does those that are due, the second none."""
    target = VersionedTarget(spark, temporary(spark, "target"))
    have = rendered_versions(table(spark, d, "manifest_entry")).withColumnRenamed("rendered_ms", "version_ms")
    at = target.publish(have, 0, ["k", "number"])
    source = item_versions(table(spark, d, "gh_issue"))
    done = None
    for run in (1, 2):
        before, at = at, run_incremental(source, target, ["k", "number"], "version_ms", lambda items: items)
        if at > before:
            did = target.added(at).select(F.lit(run).alias("run"), "repo", "number", "version_ms")
            done = did if done is None else done.unionByName(did)
    return done if done is not None else spark.createDataFrame([], "run int, repo string, number bigint, version_ms bigint")


@query
def sync_stream(spark, d):
    """The issues as a stream of files, merged into a target in micro-batches: the latest version of each item."""
    from tessera.streaming.sync import upsert_stream

    at = temporary(spark, "stream")
    issues = table(spark, d, "gh_issue").select("repo", "number", "updated_at", "row_id").withColumn("version", F.struct("updated_at", "row_id").cast("struct<updated_at: string, row_id: bigint>"))
    issues.where(F.col("updated_at").isNotNull()).write.parquet(f"{at}/source")
    target = upsert_stream(spark, f"{at}/source", spark.read.parquet(f"{at}/source").schema, f"{at}/target", f"{at}/checkpoint", ["repo", "number"], "version", fmt="parquet", files_per_batch=4)
    return target.read().select("repo", "number", "row_id", "updated_at")
