"""Preorder positions, subtree ranges and depths of the prefix tree."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.functions.prefixes import prefix_array

#: Nodes per range partition that the distributed numbering aims at.
NODES_A_RANGE = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where a session of one machine
    (tests, a laptop) names none, it's a temporary folder that is then set; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="arborlake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/numbering-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_positions(nodes: DataFrame, ranges: int | None = None) -> DataFrame:
    """``nodes`` with ``pos``, the place in byte order of the prefix, from 0 without gaps.

    Byte order is preorder. A window over everything would bring all nodes to one task; instead the
    nodes are cut into ranges by prefix, written (so that the sampled range bounds are fixed), counted
    per range, and numbered inside each range from where the ranges before it end.
    """
    if ranges is None:  # counted where they are written, so that nothing is computed twice
        nodes = _written(nodes)
        ranges = max(1, -(-nodes.count() // NODES_A_RANGE))
    if ranges == 1:
        return nodes.withColumn("pos", F.row_number().over(Window.orderBy("prefix")).cast("long") - 1)
    cut = _written(nodes.repartitionByRange(ranges, "prefix").withColumn("range_id", F.spark_partition_id()))
    base, rows = 0, []
    for r in cut.groupBy("range_id").count().orderBy("range_id").collect():
        rows.append({"range_id": r["range_id"], "base": base})
        base += r["count"]
    starts = cut.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), F.lit("array<struct<range_id:int,base:bigint>>"))))
    inside = F.row_number().over(Window.partitionBy("range_id").orderBy("prefix")).cast("long") - 1
    return cut.join(F.broadcast(starts), "range_id").withColumn("pos", F.col("base") + inside).drop("base", "range_id")


def with_subtrees(nodes: DataFrame) -> DataFrame:
    """Numbered nodes with ``subtree_end`` (the last position inside, inclusive) and
    ``max_depth_in_subtree``.

    Each node reports itself to all its ancestors, which take the maximum: an equi-join and a combining
    aggregate, where a join on "starts with" or on position ranges would compare all pairs.
    """
    reports = nodes.select(F.inline(F.transform(prefix_array(F.col("prefix")), lambda p: F.struct(p["prefix"].alias("prefix")))), "pos", "depth")
    ends = reports.groupBy("prefix").agg(F.max("pos").alias("subtree_end"), F.max("depth").alias("max_depth_in_subtree"))
    return nodes.join(ends, "prefix")


def number_nodes(rolled: DataFrame, ranges: int | None = None) -> DataFrame:
    """A rollup as the node table: prefix, depth, pos, subtree_end, max_depth_in_subtree, sums."""
    sums = [c for c in rolled.columns if c not in ("prefix", "depth")]
    nodes = with_subtrees(with_positions(rolled, ranges))
    return nodes.select("prefix", "depth", "pos", "subtree_end", "max_depth_in_subtree", *sums)
