"""Issues and their comments as Markdown files, incrementally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

KINDS = ("issues", "prs")


def kind(pull_request: Column) -> Column:
    return F.when(pull_request.isNotNull(), "prs").otherwise("issues")


def kinds_of(include: str) -> list[str]:
    found = [x.strip() for x in include.split(",")]
    if not set(found) & set(KINDS):
        raise ValueError("include must contain at least one of: issues, prs")
    return found


def kind_filter(issues: DataFrame, include: str = "issues,prs") -> DataFrame:
    wanted = kinds_of(include)
    return issues.where(kind(F.col("pull_request")).isin(*wanted))


def state_filter(issues: DataFrame, state: str = "open") -> DataFrame:
    return issues if state == "all" else issues.where(F.col("state") == state)


def label_filter(issues: DataFrame, labels: list[str]) -> DataFrame:
    """Items that carry all the labels; items without labels carry none."""
    have = F.coalesce(F.col("labels.name"), F.array().cast("array<string>"))
    return issues.where(F.size(F.array_except(F.array(*map(F.lit, labels)).cast("array<string>"), have)) == 0) if labels else issues


def since_filter(issues: DataFrame, since: str | None) -> DataFrame:
    """Updated at or after the watermark, as strings; null means from the start."""
    return issues if since is None else issues.where(F.col("updated_at") >= since)


def effective_since(saved: str | None, given: str | None = None, force: bool = False) -> str | None:
    return None if force else saved if given in (None, "last") else given


def first_items(issues: DataFrame, limit: int | None, key: list[str] = ["number"]) -> DataFrame:
    """The first in the order of updates."""
    return issues if limit is None else issues.orderBy("updated_at", *key).limit(limit)


def latest_items(issues: DataFrame, key: list[str] = ["number"], version: str = "updated_at", tie: str | None = None) -> DataFrame:
    """One row per key, the latest; the map-side maximum keeps one row per key and partition."""
    others = [c for c in issues.columns if c not in key]
    order = F.struct(F.col(version).alias("__v"), *([F.col(tie).alias("__t")] if tie else []))
    best = issues.groupBy(*key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), order).alias("m"))
    return best.select(*key, *[F.col(f"m.`{c}`").alias(c) for c in others]).select(*issues.columns)


def watermark(issues: DataFrame) -> DataFrame:
    """(last_sync, item_count) of the items of a run."""
    return issues.agg(F.max("updated_at").alias("last_sync"), F.count(F.lit(1)).alias("item_count"))


def with_comments(issues: DataFrame, comments: DataFrame, key: list[str], mode: str = "inline") -> DataFrame:
    """issues with comments array<struct<created_at, login, body>> in the order of creation; items without a body, or in
    any mode but inline, have none."""
    empty = F.array().cast("array<struct<created_at: string, login: string, body: string>>")
    if mode != "inline":
        return issues.withColumn("comments", empty)
    one = F.struct("created_at", F.col("user.login").alias("login"), F.coalesce("body", F.lit("")).alias("body"))
    per = comments.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("__c"))  # an item's own comments
    joined = issues.join(per, key, "left")
    return joined.withColumn("comments", F.when(F.col("body").isNotNull(), F.coalesce("__c", empty)).otherwise(empty)).drop("__c")


def markdown(with_comments_column: bool = True) -> Column:
    """The document of an item: front matter, title, body, comments."""
    pr = F.col("pull_request").isNotNull()
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    names = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    listed = lambda label, c: F.when(F.size(names(c)) > 0, F.concat(F.lit(f"{label}: ["), F.array_join(names(c), ", "), F.lit("]\n"))).otherwise("")
    line = lambda label, c: F.concat(F.lit(f"{label}: "), text(c), F.lit("\n"))
    head = F.concat(
        F.lit("---\n"),
        line("type", F.when(pr, "pull_request").otherwise("issue")),
        line("number", F.col("number")),
        F.concat(F.lit('title: "'), T.escape_yaml(text(F.col("title"))), F.lit('"\n')),
        line("state", F.col("state")),
        line("author", F.col("user.login")),
        listed("assignees", F.col("assignees.login")),
        listed("labels", F.col("labels.name")),
        line("created", F.col("created_at")),
        line("updated", F.col("updated_at")),
        line("url", F.col("html_url")),
        F.lit("---\n\n"),
    )
    title = F.concat(F.lit("# "), F.when(pr, "PR").otherwise("Issue"), F.lit(" #"), text(F.col("number")), F.lit(": "), text(F.col("title")), F.lit("\n\n"))
    body = F.when(T.trim_space(text(F.col("body"))) != "", F.concat(T.trim_space(F.col("body")), F.lit("\n\n"))).otherwise("")
    parts = [head, title, body]
    if with_comments_column:
        each = F.transform("comments", lambda c: F.concat(F.lit("### @"), text(c["login"]), F.lit(" ("), text(c["created_at"]), F.lit(")\n\n"), T.trim_space(text(c["body"])), F.lit("\n\n")))
        parts.append(F.when(F.size("comments") > 0, F.concat(F.lit("---\n\n## Comments\n\n"), F.array_join(each, ""))).otherwise(""))
    return F.concat(*parts)


def item_path() -> Column:
    return F.concat(kind(F.col("pull_request")), F.lit("/"), F.col("number").cast("string"), F.lit("-"), T.slugify(F.coalesce("title", F.lit(""))), F.lit(".md"))


def rendered(issues: DataFrame, comments: DataFrame, key: list[str], mode: str = "inline") -> DataFrame:
    """The key, kind, path, updated_at and markdown of each item."""
    df = with_comments(issues, comments, key, mode)
    return df.select(*key, kind(F.col("pull_request")).alias("kind"), item_path().alias("path"), "updated_at", markdown().alias("markdown"))


def manifest_header(items: DataFrame, owner: str, repo: str, include: str = "issues,prs") -> DataFrame:
    """One row: what a manifest says of a run as a whole. items is (number, kind, path, updated_at) of one repository."""
    return items.agg(F.max("updated_at").alias("synced_at")).select(
        F.lit(1).alias("version"), F.lit("github").alias("source_type"), F.lit(owner).alias("owner"), F.lit(repo).alias("repo"), F.array(*map(F.lit, kinds_of(include))).alias("included_kinds"), "synced_at"
    )


def manifest_lines(items: DataFrame) -> DataFrame:
    """items with line, the JSON of each one's entry; in no order, so that no repository is gathered in one row."""
    return items.withColumn("line", F.to_json(F.struct("number", "kind", "path", "updated_at"), {"ignoreNullFields": "false"}))


def manifest_summary(items: DataFrame) -> DataFrame:
    """Per repository: entries, latest update and kinds; counts only, so no repository is gathered in one task."""
    return items.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.max("updated_at").alias("synced_at"), F.count_if(F.col("kind") == "prs").alias("n_prs"), F.count_if(F.col("kind") == "issues").alias("n_issues")
    )


