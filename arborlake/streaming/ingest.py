"""Inventory files as a stream: the rollup is kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from arborlake.operators.rollup import merge_rollups, rollup

OBJECTS = T.StructType([T.StructField("key", T.StringType()), T.StructField("size", T.LongType())])


def read_object_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """Parquet files with key and size, as they appear in a folder."""
    rows = spark.readStream.schema(OBJECTS).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return rows.where(F.col("key") != "").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))


def streaming_rollup(objects: DataFrame, max_depth: int = 0) -> DataFrame:
    """(prefix, depth, object_count, total_bytes) of all objects so far, for complete or update mode.

    Spark allows one aggregation of this kind in a stream, so that objects are exploded directly.
    """
    from arborlake.operators.rollup import rollup_direct

    return rollup_direct(objects, max_depth=max_depth)


def start_rollup_table(objects: DataFrame, table: str, checkpoint: str, max_depth: int = 0) -> StreamingQuery:
    """Appends a rollup of every micro-batch to ``table/batch=<n>``: the two-step rollup of a batch runs
    as in a batch job, and a batch that is tried again overwrites its own folder. :func:`current_rollup`
    sums them up."""

    def write(batch: DataFrame, number: int) -> None:
        rollup(batch, max_depth=max_depth).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return objects.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rollup(spark: SparkSession, table: str) -> DataFrame:
    """The rollup of all batches written so far."""
    return merge_rollups(spark.read.parquet(table).drop("batch"))
