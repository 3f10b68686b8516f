"""Rollup of objects along the key hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.prefixes import capped_depth, parent_dir, prefix_array, prefix_depth
from arborlake.functions.tiers import N_TIERS

TIER_COLUMNS = [f"t{i}_{what}" for what in ("count", "bytes") for i in range(N_TIERS)]
TOTALS = ["object_count", "total_bytes"]


def explode_prefixes(objects: DataFrame, max_depth: int = 0) -> DataFrame:
    """A row per object and prefix: the columns of ``objects`` with ``depth`` and ``prefix``."""
    return objects.select("*", F.inline(prefix_array(F.col("key"), max_depth)))


def _tier_sums(count: Column, size: Column) -> list[Column]:
    at = [F.col("tier_id") == i for i in range(N_TIERS)]
    return [F.sum(F.when(c, count).otherwise(0)).alias(f"t{i}_count") for i, c in enumerate(at)] + [F.sum(F.when(c, size).otherwise(0)).alias(f"t{i}_bytes") for i, c in enumerate(at)]


def directories(objects: DataFrame, *, tiers: bool = False, max_depth: int = 0) -> DataFrame:
    """Objects aggregated by their directory (the deepest prefix within ``max_depth``), before any
    ancestor is written out: (prefix, object_count, total_bytes and, with ``tiers``, the tier sums)."""
    one, size = F.lit(1).cast("long"), F.col("size")
    sums = [F.count("*").alias("object_count"), F.sum(size).alias("total_bytes")]
    grouped = objects.groupBy(parent_dir(F.col("key"), max_depth).alias("prefix"))
    return grouped.agg(*sums, *(_tier_sums(one, size) if tiers else []))


def rollup(objects: DataFrame, *, tiers: bool = False, max_depth: int = 0) -> DataFrame:
    """(prefix, depth, totals and, with ``tiers``, ``t{i}_count`` and ``t{i}_bytes``) for every prefix.

    The aggregation is in two steps: objects to their directory, then directories to their ancestors.
    Spark doesn't push an aggregate below an explode; here the explode sees each distinct directory
    once, not each object. Both steps combine on the map side, so hot directories, and the root, come
    to a shuffle as one row per task. No objects give no rows, not even a root.
    """
    dirs = directories(objects, tiers=tiers, max_depth=max_depth)
    columns = TOTALS + TIER_COLUMNS * tiers
    flat = dirs.select(F.inline(prefix_array(F.col("prefix"))), *columns).drop("depth")
    # Dealt by prefix alone: what groups by prefix afterwards needs no further shuffle.
    whole = flat.groupBy("prefix").agg(*[F.sum(c).alias(c) for c in columns])
    return whole.select("prefix", prefix_depth(F.col("prefix")).alias("depth"), *columns)


def rollup_direct(objects: DataFrame, *, max_depth: int = 0) -> DataFrame:
    """The same totals in one step, every object exploded; for comparison and few objects."""
    return explode_prefixes(objects, max_depth).groupBy("prefix", "depth").agg(F.count("*").alias("object_count"), F.sum("size").alias("total_bytes"))


def rollup_tiers_long(objects: DataFrame, *, max_depth: int = 0) -> DataFrame:
    """(prefix, depth, tier_id, object_count, total_bytes): only tiers that occur at the prefix."""
    dirs = objects.groupBy(parent_dir(F.col("key"), max_depth).alias("dir"), "tier_id").agg(F.count("*").alias("object_count"), F.sum("size").alias("total_bytes"))
    flat = dirs.select("tier_id", F.inline(prefix_array(F.col("dir"))), *TOTALS)
    return flat.groupBy("prefix", "depth", "tier_id").agg(*[F.sum(c).alias(c) for c in TOTALS])


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """Rollups of disjoint sets of objects as the rollup of all: rows of a prefix are summed."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    columns = [c for c in whole.columns if c in TOTALS or c in TIER_COLUMNS]
    return whole.groupBy("prefix", "depth").agg(*[F.sum(F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in columns])


def prefix_rows(objects: DataFrame, max_depth: int = 0) -> DataFrame:
    """(key, depth, prefix) of every object, the root among them."""
    return objects.select("key", F.inline(prefix_array(F.col("key"), max_depth)))


__all__ = ["TIER_COLUMNS", "TOTALS", "capped_depth", "directories", "explode_prefixes", "merge_rollups", "prefix_rows", "rollup", "rollup_direct", "rollup_tiers_long"]
