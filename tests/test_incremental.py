import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tessera.operators.incremental import VersionedTarget, instant_millis, pending_items, run_incremental, saved_watermarks
from tessera.streaming.sync import upsert_stream


def test_notations(spark):
    at = 1_735_787_045_000
    same = ["2025-01-02T03:04:05Z", "2025-01-02 03:04:05", "2025-01-02T03:04:05.000Z", "2025-01-02T05:04:05+02:00", "2025-01-01T19:04:05.000-08:00", "2025-01-02t03:04:05z", " 2025-01-02T05:04:05+0200 ", "2025-01-02 03:04:05.0009"]
    df = spark.createDataFrame([(s,) for s in [*same, "", "soon", None, "2025-13-01T00:00:00Z"]], "s string").select(instant_millis(F.col("s")).alias("t"))
    assert [r["t"] for r in df.collect()] == [at] * len(same) + [None] * 4


ISSUE = "repo string, number bigint, updated_at string, other int"


def test_pending(spark):
    issues = spark.createDataFrame(
        [("A/b", 1, "2025-01-01T00:00:00Z", 1), ("A/b", 1, "2025-01-02T00:00:00Z", 2), ("A/b", 2, "2025-01-01T02:00:00+02:00", 1), ("A/b", 3, None, 1), ("A/b", 4, None, 1), (None, 5, "2025-01-01T00:00:00Z", 1), ("A/b", None, "2025-01-01T00:00:00Z", 1), ("A/b", 6, "2025-01-01T00:00:00.002Z", 1)],
        ISSUE,
    )
    manifest = spark.createDataFrame(
        [("a/B", 1, "2025-01-01T00:00:00Z"), ("a/b", 2, "2025-01-01T00:00:00.000Z"), ("a/b", 3, "2025-01-01T00:00:00Z"), ("a/b", 4, None), ("a/b", 6, "2025-01-01 00:00:00.001"), ("z/z", 9, "2025-01-01T00:00:00Z")], "repo string, number bigint, updated_at string"
    )
    assert rows(pending_items(issues, manifest), "repo", "number", "reason") == [("A/b", 1, "changed"), ("A/b", 4, "new"), ("A/b", 6, "changed")]
    assert pending_items(issues.where("false"), manifest).collect() == []
    assert pending_items(issues, manifest.where("false")).count() == 5


def test_watermarks(spark):
    t = lambda d: datetime.datetime(2025, 1, d)
    df = spark.createDataFrame([("2025-01-01T00:00:00Z", "a/b", t(1)), ("", "A/b", t(3)), ("2025-01-02T00:00:00Z", "A/B", t(2)), ("bad", "c/d", t(1))], "last_sync string, repo string, saved_at timestamp")
    assert rows(saved_watermarks(df), "repo", "last_sync_ms") == [("a/b", 1735776000000)]


def test_runs_survive_failures(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path / "t"))
    src = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 1, "z")], "k string, v int, body string")
    seen = []

    def render(df):
        seen.append(sorted((r["k"], r["v"]) for r in df.collect()))
        return df.withColumn("body", F.upper("body"))

    assert target.read() is None
    assert run_incremental(src, target, ["k"], "v", render) == 1
    assert rows(target.read(), "k", "v", "body") == [("a", 2, "Y"), ("b", 1, "Z")]
    assert run_incremental(src, target, ["k"], "v", render) == 1  # nothing is done again
    more = src.unionByName(spark.createDataFrame([("b", 3, "q"), ("c", 1, "n")], src.schema))

    def fail(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run_incremental(more, target, ["k"], "v", fail)
    assert target.version() == 1
    assert run_incremental(more, target, ["k"], "v", render) == 2
    assert seen == [[("a", 2), ("b", 1)], [("b", 3), ("c", 1)]]
    assert rows(target.read(), "k", "v") == [("a", 2), ("b", 3), ("c", 1)] and rows(target.read(1), "k", "v") == [("a", 2), ("b", 1)]
    with pytest.raises(RuntimeError):
        target.publish(src, 1, ["k"])  # another run was first
    assert target.version() == 2


def test_stream(spark, tmp_path):
    source, schema = str(tmp_path / "s"), "k string, v int, body string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).write.parquet(source + "/1")
    args = (spark, source + "/*", spark.createDataFrame([], schema).schema, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], "v", "parquet")
    assert rows(upsert_stream(*args).read(), "k", "v") == [("a", 1), ("b", 1)]
    spark.createDataFrame([("a", 2, "x2"), ("b", 0, "late")], schema).write.parquet(source + "/2")
    out = upsert_stream(*args)
    assert rows(out.read(), "k", "v") == [("a", 2), ("b", 1)] and out.version() == 2
    upsert_stream(*args)
    assert out.version() == 2


def test_parts(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path / "t"))
    df = lambda *r: spark.createDataFrame(list(r), "k string, v int, body string")
    first = df(*[(f"k{i}", 1, "x" * 50) for i in range(1000)])
    run = lambda d: run_incremental(d, target, ["k"], "v", lambda x: x)
    assert run(first) == 1 and run(df(("k1", 2, "y"), ("k2", 1, "late"), ("new", None, "n"))) == 2
    assert rows(target.added(2), "k", "v") == [("k1", 2), ("new", None)]  # only the change is written
    assert target.read().count() == 1001 and rows(target.read().where("k = 'k1'"), "v", "body") == [(2, "y")]
    assert run(df(("new", None, "n"))) == 2 and run(df(("new", 1, "n"))) == 3
    assert rows(target.read().where("k = 'new'"), "v") == [(1,)] and target.read(1).count() == 1000
    assert target.compact() == 4 and target.read().count() == 1001
    assert len(target.expire()) == 3 and target.versions() == [4] and target.read().count() == 1001


def test_one_of_two_runs_wins(spark, tmp_path):
    a, b = (VersionedTarget(spark, f"file://{tmp_path}/t") for _ in "ab")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    assert a.publish(df, 0, ["k"]) == 1
    with pytest.raises(RuntimeError, match="another run"):
        b.publish(df, 0, ["k"])
    assert b.read().count() == 1


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tessera import runtime

    bare = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(bare("spark://host:7077"))
    assert runtime.shared_dir(bare("local[4]")).startswith("file:")
    runtime.release(spark)
    runtime.written(spark.range(3))
    assert runtime.release(spark) == 1
