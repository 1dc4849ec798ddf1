"""python -m tessera.cli QUERY [PATH...]: search files; python -m tessera.cli sync DUMP OUTPUT: render issue dumps."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import embed, sync
from tessera.plans.search import SearchEngine
from tessera.sources import files, git, issues, results
from tessera.spec import SearchSpec, valid_query


def _session() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def search(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("query")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("-k", "--top", type=int, default=10)
    p.add_argument("-t", "--threshold", type=float)
    p.add_argument("-C", "--context", type=int, default=2)
    p.add_argument("-g", "--glob")
    p.add_argument("--chunk-size", type=int, default=512)
    p.add_argument("--overlap", type=float, default=0.2)
    p.add_argument("--hidden", action="store_true")
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("--literal", action="append", default=[])
    p.add_argument("--fast", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--model", help="name of a model in ./models or in the data folder")
    p.add_argument("--model-dir")
    p.add_argument("--data-dir", default=files.data_folder(), help="folder with models and synced items")
    a = p.parse_args(argv)
    if not valid_query(a.query):
        return _nothing("the query needs a word of at least two characters")
    for path in a.paths:
        if not os.path.exists(path):
            print(f"no such path: {path}", file=sys.stderr)
            return 1
    model = embed.resolve_model(a.model, a.model_dir, a.data_dir)
    spark = _session()
    found = files.read_files(spark, a.paths, a.hidden, not a.no_gitignore, a.glob)
    of = git.repository(".")
    synced = files.synced_files(spark, *of, a.data_dir) if of else None
    if synced is not None:
        found = files.with_synced(found, synced, a.paths, a.glob)
    spec = SearchSpec(a.query, a.top, a.threshold, a.context, None, a.chunk_size, a.overlap, literals=tuple(a.literal), fast=a.fast)
    engine = SearchEngine(spark, model)
    shown = engine.search(found, spec, git.commits(spark, "."))
    print(engine.stats, file=sys.stderr)
    if not engine.stats["seen"]:
        return _nothing("no files found")
    if not engine.stats["chunks"]:
        return _nothing(f"no chunks produced from {engine.stats['scored']} files")
    out = "".join(r["json"] for r in results.as_json(shown).collect()) if a.json else results.as_text(shown, a.context)
    if not out:
        return _nothing("no results" + (" above the threshold" if a.threshold is not None else ""))
    print(out)
    return 0


def _nothing(why: str) -> int:
    """Says on stderr why there is nothing on stdout, which is no failure."""
    print(why, file=sys.stderr)
    return 0


def run_sync(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tessera sync")
    p.add_argument("dump", help="folder with issues.json and comments.json, one object per line")
    p.add_argument("output")
    p.add_argument("--repo", default="owner/repo")
    p.add_argument("--include", default="issues,prs")
    p.add_argument("--state", default="open")
    p.add_argument("--labels", default="")
    p.add_argument("--limit", type=int)
    p.add_argument("--since")
    p.add_argument("--force", action="store_true")
    p.add_argument("--comments", default="inline")
    p.add_argument("--prune", action="store_true")
    a = p.parse_args(argv)
    owner, repo = git.repo_argument(a.repo)
    spark = _session()
    saved = issues.read_state(a.output)
    since = sync.effective_since(saved["last_sync"] if saved else None, a.since, a.force)
    items = issues.read_issues(spark, os.path.join(a.dump, "issues.json"))
    items = sync.state_filter(sync.since_filter(sync.latest_items(items), since), a.state)
    items = sync.label_filter(sync.kind_filter(items, a.include), [x.strip() for x in a.labels.split(",") if x.strip()])
    items = sync.first_items(items, a.limit)
    made = sync.rendered(items, issues.read_comments(spark, os.path.join(a.dump, "comments.json")), ["number"], a.comments).cache()
    if made.isEmpty():
        print("no items found", file=sys.stderr)
        return 0
    issues.write_markdown(made, a.output)
    if a.prune:
        issues.prune_markdown(made, a.output)
    state = sync.watermark(made).select("last_sync", F.lit(a.repo).alias("repo"), F.array(*map(F.lit, sync.kinds_of(a.include))).alias("include"), "item_count").first()
    issues.write_manifest(sync.manifest_header(made, owner, repo, a.include), sync.manifest_lines(made), a.output)
    issues.write_state(state, a.output)
    return 0


def main(argv: list[str]) -> int:
    return run_sync(argv[1:]) if argv[:1] == ["sync"] else search(argv)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
