"""Continuous ingestion of issue dumps: a file stream into the versioned target, each micro-batch merged once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.incremental import VersionedTarget, run_incremental
from tessera.operators.sync import item_path, kind, latest_items, markdown


def upsert_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: list[str], version: str, fmt: str = "json", files_per_batch: int = 1000) -> VersionedTarget:
    """Read what is new in source and merge it into target by key and version; ends when all that is there is read.

    The checkpoint remembers the files of each batch. A batch that ran but was not noted runs again, and changes nothing,
    as its rows are no newer than those in the target: each record counts once whatever fails when.
    """
    out = VersionedTarget(spark, target)

    def merge(batch: DataFrame, _: int) -> None:
        latest = latest_items(batch.where(F.col(version).isNotNull()), key, version)
        run_incremental(latest, out, key, version, lambda df: df)

    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return out


def render_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> VersionedTarget:
    """The same for issues, with their Markdown."""
    out = VersionedTarget(spark, target)

    def render(df: DataFrame) -> DataFrame:
        return df.select("number", "updated_at", kind(F.col("pull_request")).alias("kind"), item_path().alias("path"), markdown(False).alias("markdown"))

    def merge(batch: DataFrame, _: int) -> None:
        run_incremental(latest_items(batch.where(F.col("updated_at").isNotNull())), out, ["number"], "updated_at", render)

    stream = spark.readStream.schema(schema).format("json").load(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return out
