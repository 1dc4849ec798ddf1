"""Files of a folder tree as rows, with ignore rules."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import files as O
from tessera.schemas import FILES
from tessera.spec import MAX_FILE_BYTES


class IgnoreRules:
    """Rules of one ignore file, for paths relative to its folder. The last rule that matches decides."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((re.compile(self._pattern(line.lstrip("/"), anchored)), folder, negated))

    @staticmethod
    def _pattern(glob: str, anchored: bool) -> str:
        out, i = "" if anchored else "(?:.*/)?", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("/**", i) and i + 3 == len(glob):
                out, i = out + "/.*", i + 3
            elif glob[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif glob[i] == "?":
                out, i = out + "[^/]", i + 1
            elif glob[i] == "[" and "]" in glob[i + 2 :]:
                j = glob.index("]", i + 2)
                inner = glob[i + 1 : j]
                out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
                i = j + 1
            elif glob[i] == "\\" and i + 1 < len(glob):
                out, i = out + re.escape(glob[i + 1]), i + 2
            else:
                out, i = out + re.escape(glob[i]), i + 1
        return out + r"\Z"

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True ignored, False taken back, None not mentioned."""
        found = None
        for pattern, folder, negated in self.rules:
            if (is_dir or not folder) and pattern.match(path):
                found = not negated
        return found


def list_files(root: str, hidden: bool = False, gitignore: bool = True, own_ignore: str = ".searchignore") -> list[str]:
    """Regular files below root in path order. Dot names are skipped unless hidden; .gitignore, .git/info/exclude and the
    user's global ignore file hold unless gitignore is off; .ignore and own_ignore always hold. Rules of the folders
    above root hold too, those of .gitignore up to the top of the repository. The nearest rule decides. Links are not
    followed; unreadable folders are skipped."""
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if os.path.isfile(root):
        return [root]
    found: list[str] = []

    def rules_in(folder: str, with_git: bool = gitignore) -> list[IgnoreRules]:
        names = ([".git/info/exclude", ".gitignore"] if with_git else []) + [".ignore", own_ignore]
        return [r for n in names if (r := _rules(os.path.join(folder, n)))]

    def above() -> list[tuple[str, IgnoreRules]]:
        folders = []
        at = os.path.abspath(root)
        while (up := os.path.dirname(at)) != at:
            folders.append(up)
            at = up
        top = next((i for i, f in enumerate([os.path.abspath(root), *folders]) if os.path.exists(os.path.join(f, ".git"))), -1)
        chain = [(f, r) for i, f in reversed(list(enumerate(folders))) for r in rules_in(f, gitignore and i < top)]
        everywhere = _rules(_global_ignore_file()) if gitignore else None
        return ([(([os.path.abspath(root), *folders])[max(top, 0)], everywhere)] if everywhere else []) + chain

    def visit(folder: str, chain: list[tuple[str, IgnoreRules]]) -> None:
        chain = chain + [(folder, r) for r in rules_in(folder)]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if e.name.startswith(".") and not hidden or e.name == ".git":
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            verdict = None
            for base, rules in chain:
                v = rules.verdict(os.path.relpath(os.path.abspath(e.path), os.path.abspath(base)).replace(os.sep, "/"), is_dir)
                verdict = v if v is not None else verdict
            if verdict:
                continue
            if is_dir:
                visit(e.path, chain)
            elif e.is_file(follow_symlinks=False):
                found.append(e.path)

    visit(root, above())
    return sorted(found)


def _rules(path: str) -> IgnoreRules | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return IgnoreRules(f.read())
    except OSError:
        return None


def _global_ignore_file() -> str:
    """What the user's version control ignores everywhere: core.excludesFile, else the file of that name by default."""
    try:
        run = subprocess.run(["git", "config", "--get", "--path", "core.excludesFile"], capture_output=True, text=True, timeout=10)
        if run.returncode == 0 and run.stdout.strip():
            return run.stdout.strip()
    except (OSError, subprocess.TimeoutExpired):
        pass
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")


def read_files(spark: SparkSession, roots: list[str], hidden: bool = False, gitignore: bool = True, glob: str | None = None) -> DataFrame:
    """(path, length, content) of the text files below the roots, each once though roots overlap. Denied extensions, empty
    and large files are dropped before any content is read, files that are not UTF-8 after."""
    paths = sorted({p for r in roots for p in list_files(r, hidden, gitignore)})
    if not paths:
        return spark.createDataFrame([], FILES)
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(paths).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length", "content")
    return O.utf8_filter(O.extension_filter(df).where(F.col("length").between(1, MAX_FILE_BYTES)))


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """The same for a folder on any file system, listed by the cluster, without ignore files; hidden names are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root).select("path", "length", "content")
    return O.utf8_filter(O.extension_filter(df).where(F.col("length").between(1, MAX_FILE_BYTES)))


def with_synced(files: DataFrame, synced: DataFrame, roots: list[str], glob: str | None = None) -> DataFrame:
    """files and the synced Markdown items, unless a glob is given or a root is among the synced folders itself."""
    if glob or any("sources/github" in r.replace("\\", "/") for r in roots):
        return files
    return files.unionByName(synced.where(F.col("path").rlike(r"/(?:issues|prs)/[^/]*\.md$")))


def data_folder() -> str:
    """Where models and synced items of this user are kept."""
    return os.path.join(os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share"), "tessera")


def synced_files(spark: SparkSession, owner: str, repo: str, data: str | None = None) -> DataFrame | None:
    """(path, length, content) of the Markdown synced for a repository, none if there is no such folder."""
    root = os.path.join(data or data_folder(), "sources", "github", owner, repo)
    return read_tree(spark, root, "*.md").withColumn("path", F.regexp_replace("path", r"^file:/+", "/")) if os.path.isdir(root) else None
