"""Version history as rows: (commit, path), from the text of a log, and the repository's address."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

_REMOTE = re.compile(r"(?:git@github\.com:|https?://github\.com/|ssh://git@github\.com/)(.*)")


def parse_log(log: str, strict: bool = False) -> list[tuple[str, str]]:
    """(commit, path) of a log of hashes and changed names. strict leaves out the last commit, which a reader that closes
    a commit at the next empty line never closes."""
    rows: list[tuple[str, str]] = []
    commit = ""
    for line in log.splitlines():
        if re.fullmatch(r"[0-9a-fA-F]{40}", line):
            commit = line
        elif line:
            rows.append((commit, line.replace("\\", "/")))
    if strict and rows:
        rows = [r for r in rows if r[0] != commit]
    return rows


def commits(spark: SparkSession, folder: str, last: int = 200, strict: bool = False) -> DataFrame:
    """The last commits of the repository in folder; none if there is no history to read."""
    try:
        run = subprocess.run(["git", "-C", folder, "log", "--format=%H", "--name-only", "-n", str(last)], capture_output=True, text=True, errors="replace", timeout=60)
        rows = parse_log(run.stdout, strict) if run.returncode == 0 else []
    except (OSError, subprocess.TimeoutExpired):
        rows = []
    return spark.createDataFrame(rows, "commit string, path string")


def owner_and_repo(url: str) -> tuple[str, str] | None:
    """Of an address on the forge; .git goes before a final slash does."""
    m = _REMOTE.match(url.strip())
    if not m:
        return None
    rest = m.group(1)
    while rest.endswith(".git"):
        rest = rest[:-4]
    owner, _, repo = rest.rstrip("/").partition("/")
    return (owner, repo) if owner and repo else None


def remote_of(listing: str) -> tuple[str, str] | None:
    """From the text of a list of remotes, origin first."""
    rows = [line.split() for line in listing.splitlines() if len(line.split()) >= 2]
    for name, url, *_ in sorted(rows, key=lambda r: r[0] != "origin"):
        if found := owner_and_repo(url):
            return found
    return None


def repository(folder: str) -> tuple[str, str] | None:
    """Owner and repo of the folder's remote on the forge; none if there is none."""
    try:
        run = subprocess.run(["git", "-C", folder, "remote", "-v"], capture_output=True, text=True, errors="replace", timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return remote_of(run.stdout) if run.returncode == 0 else None


def repo_argument(text: str) -> tuple[str, str]:
    owner, _, repo = text.partition("/")
    if not owner or not repo:
        raise ValueError("expected owner/repo")
    return owner, repo
