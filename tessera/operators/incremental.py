"""Processing only new or changed records, with the target as the state.

Each output row stores the key and the version of the source row it was made from; what a run has to do is the source
without what the target holds. A run writes its rows, and nothing else, as one more part of the target, and publishes
them by one atomic creation of a manifest that lists the files of all parts; a run that fails before that leaves nothing
that later runs could see.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def instant_millis(value: Column) -> Column:
    """Milliseconds since the epoch of a time string in any of the ISO notations (blank or T, fraction, Z or offset; a
    time without an offset is UTC) or of a timestamp's string; null if empty or unreadable."""
    s = F.upper(F.trim(value))
    zoned = F.when(s.rlike(r"(?:Z|[+-]\d\d(?::?\d\d)?)$") & s.rlike(r"\d\d:\d\d"), s).otherwise(F.concat(s, F.lit("Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d\d)(\d\d)$", "$1:$2")
    iso = F.when(s.rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?\s*(?:Z|[+-]\d\d(?::?\d\d)?)?)?$"), F.regexp_replace(F.regexp_replace(zoned, ",", "."), r"^(\d{4}-\d\d-\d\d)Z$", "$1T00:00:00Z"))
    return F.unix_millis(F.regexp_replace(iso, r"\s+(Z|[+-]\d\d:?\d*)$", "$1").try_cast("timestamp"))


def latest_versions(items: DataFrame, key: list[str], version: str, also: list[str] = []) -> DataFrame:
    """One row per key: the latest version (null times are ignored) as version_ms, the least of each other column."""
    return items.groupBy(*key).agg(F.max(instant_millis(F.col(version).cast("string"))).alias("version_ms"), *[F.min(c).alias(c) for c in also])


def newer(source: DataFrame, have: DataFrame, key: list[str], version: str, have_version: str) -> DataFrame:
    """source, one row per key, without the rows whose key stands in have with the same or a later version; have_version
    is added, null for keys that have lacks. A key that stands there without a version is late for any version."""
    joined = source.join(have.select(*key, have_version, F.lit(True).alias("__there")), key, "left")
    due = F.col("__there").isNull() | F.coalesce(F.col(version) > F.col(have_version), F.col(have_version).isNull() & F.col(version).isNotNull())
    return joined.where(due).drop("__there")


def pending_items(issues: DataFrame, manifest: DataFrame) -> DataFrame:
    """The items that the next run has to render: (repo, number, version_ms, rendered_ms, reason new|changed).

    An item is (repo without regard to letter case, number). It is due if its latest updated_at is later than the latest
    updated_at of its manifest entries, to the millisecond, or if it has no manifest entry with a time. Rows without repo
    or number are no items; null and unreadable times are ignored; repeated and late rows change nothing. The manifest
    alone is the state: a saved watermark may be ahead of a failed run or behind a late landing, so none is used to skip.
    """
    reason = F.when(F.col("rendered_ms").isNull(), "new").otherwise("changed").alias("reason")
    due = newer(item_versions(issues), rendered_versions(manifest), ["k", "number"], "version_ms", "rendered_ms")
    return due.select("repo", "number", "version_ms", "rendered_ms", reason)


def item_versions(issues: DataFrame) -> DataFrame:
    """(k, number, version_ms, repo): the latest version of each item, k being the repo in small letters."""
    items = issues.where(F.col("repo").isNotNull() & F.col("number").isNotNull())
    return latest_versions(items.select("repo", "number", "updated_at", F.lower("repo").alias("k")), ["k", "number"], "updated_at", ["repo"])


def rendered_versions(manifest: DataFrame) -> DataFrame:
    """(k, number, rendered_ms): the latest time of each item that has one."""
    entries = latest_versions(manifest.select(F.lower("repo").alias("k"), "number", "updated_at"), ["k", "number"], "updated_at")
    return entries.where(F.col("version_ms").isNotNull()).withColumnRenamed("version_ms", "rendered_ms")


def saved_watermarks(sync_state: DataFrame) -> DataFrame:
    """(repo, last_sync_ms, saved_at) of the newest saved state per repo that has a readable last_sync."""
    read = sync_state.select(F.lower("repo").alias("repo"), instant_millis(F.col("last_sync")).alias("last_sync_ms"), "saved_at").where(F.col("last_sync_ms").isNotNull() & F.col("repo").isNotNull())
    return read.groupBy("repo").agg(F.max(F.struct("saved_at", "last_sync_ms")).alias("m")).select("repo", "m.last_sync_ms", "m.saved_at")


class VersionedTarget:
    """A table in a folder, of which exactly the published versions can be seen.

    A version is a list of parts, each the files that one run wrote; of a key that several parts hold, the newest one
    counts. Publishing creates _published/<n>.json and fails if that version exists (two runs at once: one wins, the
    other must start again). The creation is exclusive and whole: a hard link on a local disk, else a rename that does
    not overwrite, which must be atomic in the file system, as it is in HDFS. Readers take the highest manifest.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/_published")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The published version; 0 before the first."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_published/{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _part(self, part: dict) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{part['folder']}/{f}" for f in part["files"]])

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of the version. Only the keys of the later parts are compared with the rows."""
        n = self.version() if version is None else version
        if n == 0:
            return None
        manifest = self._manifest(n)
        parts = [self._part(p).withColumn("__part", F.lit(i)) for i, p in enumerate(manifest["parts"])]
        if len(parts) == 1:
            return parts[0].drop("__part")
        union = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
        key = manifest["key"]
        last = union([p.select(*key, "__part") for p in parts[1:]]).groupBy(*key).agg(F.max("__part").alias("__last"))
        rows = union(parts).join(last, key, "left")
        return rows.where(F.col("__part") >= F.coalesce("__last", F.lit(0))).drop("__part", "__last")

    def added(self, version: int) -> DataFrame | None:
        """The rows that the run of this version wrote."""
        return self._part(self._manifest(version)["parts"][-1]) if version in self.versions() else None

    def publish(self, df: DataFrame, base: int, key: list[str], whole: bool = False) -> int:
        """Write df, once, as the part that makes the version after base, which the caller read; the only part if whole."""
        folder = f"data-{base + 1:08d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        files = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        parts = [] if base == 0 or whole else self._manifest(base)["parts"]
        parts.append({"folder": folder, "files": sorted(f for f in files if f.endswith(".parquet"))})
        return self._create(base + 1, {"key": key, "parts": parts})

    def _create(self, version: int, manifest: dict) -> int:
        self._fs.mkdirs(self._path(f"{self.root}/_published"))
        at = self._path(f"{self.root}/_published/{version:08d}.json")
        draft = self._path(f"{self.root}/_published/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), at.toUri().getPath())
            else:
                none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self._conf).rename(draft, at, none)
        except Exception as e:
            if self._fs.exists(at):
                raise RuntimeError(f"version {version} was published by another run; start again from it") from e
            raise
        finally:
            self._fs.delete(draft, False)
        return version

    def compact(self) -> int:
        """Publish the rows as one part, after many runs."""
        base = self.version()
        return self.publish(self.read(base), base, self._manifest(base)["key"], whole=True) if base else 0

    def expire(self, keep: int = 1) -> list[str]:
        """Delete all but the last versions, and the parts that only those held or that no version holds; returns them.
        Not while a run is writing."""
        have = self.versions()
        kept, old = have[-keep:], have[:-keep]
        used = {p["folder"] for v in kept for p in self._manifest(v)["parts"]}
        gone = [n for s in self._fs.listStatus(self._path(self.root)) if (n := s.getPath().getName()).startswith("data-") and n not in used]
        for v in old:
            self._fs.delete(self._path(f"{self.root}/_published/{v:08d}.json"), False)
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return gone


def run_incremental(source: DataFrame, target: VersionedTarget, key: list[str], version: str, render) -> int:
    """One run: render(rows of source that are new or changed) is added to the target and published.

    source has one row per key and version, version being comparable; the latest per key counts, repeated rows once. The
    rendered rows must keep key and version; they are evaluated once, where they are written, and what is written is in
    proportion to the change. Nothing to do publishes nothing. Returns the target's version after the run. Rerunning
    after a failure at any point does what was not published, and only that.
    """
    base = target.version()
    old = target.read(base)
    others = [c for c in source.columns if c not in (*key, version)]
    latest = source.groupBy(*key).agg(F.max(F.struct(version, *others)).alias("m")).select(*key, "m.*")
    if old is not None:
        have = old.groupBy(*key).agg(F.max(version).alias("__have"))
        latest = newer(latest, have, key, version, "__have").drop("__have")
    if latest.isEmpty():
        return base
    return target.publish(render(latest), base, key)
