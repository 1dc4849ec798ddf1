"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hint only below this many bytes, estimated from a count of its rows.
BROADCAST_BYTES = 8 << 20


def ready(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, unless they find it themselves. On a cluster
    whose machines don't share that folder it must be installed or sent with addPyFile."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; the directory holds one parquet file or folder per table."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only in local mode, as in tests, a temporary folder of this machine is set where that is unset; on a cluster its
    machines would not find each other's files there, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_temporary: list[str] = []


def _file_system(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _passing(spark: SparkSession, at: str) -> None:
    """Have at, which exists, deleted when the session's JVM ends or by release."""
    fs, path = _file_system(spark, at)
    fs.deleteOnExit(path)
    _temporary.append(at)


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the session's JVM ends or by release."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = _file_system(spark, at)
    fs.mkdirs(path)
    _passing(spark, at)
    return at


def release(spark: SparkSession) -> int:
    """Delete all tables written so far; for callers who have their results. Returns how many there were."""
    n = len(_temporary)
    while _temporary:
        fs, path = _file_system(spark, _temporary.pop())
        fs.delete(path, True)
    return n


def written(df: DataFrame) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back; columns can be pruned then."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        _passing(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def observed(seen: Observation) -> int:
    """The count that passed. A plan that is known to be empty passes nothing, and reports nothing."""
    try:
        return seen.get["n"]
    except Py4JError:
        return 0


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """written, and how many rows there were, counted as they passed."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, observed(seen)
