"""Dumps of issues and comments (JSON, one array or one object per line), and the sinks of a sync run."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import GH_COMMENT, GH_ISSUE


def read_issues(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    df = spark.read.schema(GH_ISSUE).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    return df.withColumn("labels", F.coalesce("labels", F.array().cast("array<struct<name: string>>"))).withColumn("assignees", F.coalesce("assignees", F.array().cast("array<struct<login: string>>")))


def read_comments(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(GH_COMMENT).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def write_markdown(rendered: DataFrame, root: str) -> None:
    """One file per row at root/path, whole or not at all: written beside and renamed. root must be a folder that all
    workers share; rewriting a row writes the same file."""

    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            at = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            draft = f"{at}.{os.getpid()}.part"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(r["markdown"])
            os.replace(draft, at)

    rendered.select("path", "markdown").foreachPartition(write)


def prune_markdown(rendered: DataFrame, root: str, at_once: int = 10_000) -> list[str]:
    """Remove the files of items that a new title has moved; returns them. Only for items in rendered, which are compared
    with the names in the folder where they are, so many names at once."""
    spark = rendered.sparkSession
    current = rendered.select("path", F.split("path", "/")[0].alias("kind"), F.regexp_extract("path", r"/(\d+)-", 1).alias("number"))
    items = current.select("kind", "number").distinct()
    gone: list[str] = []

    def compare(names: list[str]) -> None:
        have = spark.createDataFrame([(n,) for n in names], "path string").select("path", F.split("path", "/")[0].alias("kind"), F.regexp_extract("path", r"/(\d+)-", 1).alias("number"))
        for r in have.join(items, ["kind", "number"], "left_semi").join(current.select("path"), "path", "left_anti").select("path").collect():  # at_once rows at most
            os.remove(os.path.join(root, r["path"]))
            gone.append(r["path"])

    for kind in ("issues", "prs"):
        folder, names = os.path.join(root, kind), []
        for e in os.scandir(folder) if os.path.isdir(folder) else []:
            if e.name.endswith(".md"):
                names.append(f"{kind}/{e.name}")
            if len(names) == at_once:
                compare(names)
                names = []
        if names:
            compare(names)
    return sorted(gone)


def _write_json(value: dict, at: str) -> None:
    os.makedirs(os.path.dirname(at), exist_ok=True)
    draft = f"{at}.{os.getpid()}.part"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
    os.replace(draft, at)


def write_state(row: Row, root: str) -> None:
    _write_json(row.asDict(recursive=True), os.path.join(root, ".meta", "sync-state.json"))


def read_state(root: str) -> dict | None:
    """The saved state; none if it is missing or cannot be read."""
    try:
        with open(os.path.join(root, ".meta", "sync-state.json"), encoding="utf-8") as f:
            state = json.load(f)
        return state if isinstance(state, dict) and all(k in state for k in ("last_sync", "repo", "include", "item_count")) else None
    except (OSError, ValueError):
        return None


def write_manifest(header: DataFrame, lines: DataFrame, root: str) -> None:
    """The manifest of a run as one JSON file, its entries (column line, in the order of updated_at and number) streamed
    to it partition by partition."""
    os.makedirs(root, exist_ok=True)
    at = os.path.join(root, "manifest.json")
    draft = f"{at}.{os.getpid()}.part"
    with open(draft, "w", encoding="utf-8") as f:
        f.write(json.dumps(header.first().asDict(recursive=True), indent=2, ensure_ascii=False)[:-2] + ',\n  "files": [')
        for i, r in enumerate(lines.orderBy("updated_at", "number").select("line").toLocalIterator()):
            f.write(("," if i else "") + "\n    " + r["line"])
        f.write("\n  ]\n}")
    os.replace(draft, at)
