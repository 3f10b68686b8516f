"""Synthetic inventories of five shapes, made by expressions over a range of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPES = ("deep_narrow", "wide_shallow", "balanced", "realistic", "wide_single_level")
#: Shares of tiers by id, for a mixed inventory.
TIER_MIX = {0: 0.60, 1: 0.15, 3: 0.10, 7: 0.10, 10: 0.05}


def _letter(n: Column) -> Column:
    return F.chr(F.lit(97) + n % 26)


def key_of(shape: str, i: Column) -> Column:
    """The key of object number ``i``."""
    name = F.concat(F.lit("file"), i.cast("string"), F.lit(".txt"))
    if shape == "deep_narrow":
        return F.concat(F.repeat(F.concat(_letter(i), F.lit("/")), F.lit(20)), name)
    if shape == "wide_shallow":
        return F.concat(F.lit("p"), F.floor(i / 5).cast("string"), F.lit("/"), name)
    if shape == "balanced":
        return F.concat_ws("/", _letter(i), _letter(F.floor(i / 26)), _letter(F.floor(i / 676)), name)
    if shape == "realistic":
        day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 366).cast("int"))
        kind = F.element_at(F.array(*map(F.lit, ("data", "logs", "backups", "media"))), (i % 4 + 1).cast("int"))
        return F.concat_ws("/", kind, F.date_format(day, "yyyy/MM/dd"), F.format_string("user%05d", F.floor(i / 7) % 1000), name)
    if shape == "wide_single_level":
        return F.concat(F.lit("root/"), F.format_string("child%07d", i), F.lit("/file.txt"))
    raise ValueError(f"unknown shape {shape!r}; one of {', '.join(SHAPES)}")


def objects(spark: SparkSession, n: int, shape: str = "realistic", *, seed: int = 42, tiers: dict[int, float] | None = None) -> DataFrame:
    """(key, size, tier_id) of ``n`` objects. Sizes go round from 100 to 100000 in steps of 100; tiers are
    drawn by the given shares from a hash of the number, so that the same call gives the same rows."""
    mix = TIER_MIX if tiers is None else tiers
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1_000_000)) / 1_000_000
    tier, cum = None, 0.0
    for tid, share in mix.items():
        cum += share
        tier = F.when(u < cum, tid) if tier is None else tier.when(u < cum, tid)
    tier = F.lit(0) if tier is None else tier.otherwise(next(iter(mix)))
    return spark.range(n).select(key_of(shape, F.col("id")).alias("key"), ((F.col("id") % 1000 + 1) * 100).alias("size"), tier.cast("int").alias("tier_id"))


def tree(spark: SparkSession, fanout: int, depth: int, objects_a_leaf: int = 1, *, seed: int = 42, tiers: dict[int, float] | None = None) -> DataFrame:
    """Objects of a full tree: every directory down to ``depth`` has ``fanout`` others, and each of the deepest holds
    ``objects_a_leaf`` objects; so there are (fanout ** (depth + 1) - 1) / (fanout - 1) prefixes with the root."""
    n = fanout**depth * objects_a_leaf
    mix = objects(spark, n, "wide_shallow", seed=seed, tiers=tiers)
    leaf = F.floor(F.regexp_extract("key", r"file(\d+)", 1).cast("bigint") / objects_a_leaf)
    names = [F.concat(F.lit("d"), (F.floor(leaf / fanout ** (depth - 1 - k)) % fanout).cast("string")) for k in range(depth)]
    return mix.select(F.concat_ws("/", *names, F.regexp_extract("key", r"[^/]+$", 0)).alias("key"), "size", "tier_id")
