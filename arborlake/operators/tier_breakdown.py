"""Tier breakdowns of nodes, in long form and as a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.tiers import TIERS
from arborlake.operators.navigation import lookup
from arborlake.operators.rollup import TIER_COLUMNS


def has_tiers(nodes: DataFrame) -> bool:
    return set(TIER_COLUMNS) <= set(nodes.columns)


def breakdown_all(nodes: DataFrame) -> DataFrame:
    """(prefix, tier_id, tier_name, object_count, bytes): all tiers of every node, zeros too."""
    entries = [F.struct(F.lit(t.tier_id).alias("tier_id"), F.lit(t.tier_name).alias("tier_name"), F.col(f"t{t.tier_id}_count").alias("object_count"), F.col(f"t{t.tier_id}_bytes").alias("bytes")) for t in TIERS]
    return nodes.select("prefix", F.inline(F.array(*entries)))


def breakdown(nodes: DataFrame) -> DataFrame:
    """The same without empty tiers; a tier of zero-byte objects isn't empty."""
    return breakdown_all(nodes).where((F.col("object_count") > 0) | (F.col("bytes") > 0))


def present_tiers(nodes: DataFrame) -> DataFrame:
    """(tier_id, tier_name) of the tiers that occur anywhere, that is at the root."""
    return breakdown(lookup(nodes, "")).select("tier_id", "tier_name")


def breakdown_present(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Breakdown of the nodes ``of``, zeros included, for all tiers that occur in ``nodes``."""
    return breakdown_all(of).join(F.broadcast(present_tiers(nodes).select("tier_id")), "tier_id", "left_semi")


def breakdown_for(nodes: DataFrame, prefix: str) -> DataFrame:
    return breakdown(lookup(nodes, prefix)).orderBy("tier_id")


def breakdown_map(nodes: DataFrame) -> DataFrame:
    """(prefix, tiers): a map from tier name to (tier_id, object_count, bytes) of the non-empty ones."""
    entries = F.array(*[F.struct(F.lit(t.tier_name).alias("key"), F.struct(F.lit(t.tier_id).alias("tier_id"), F.col(f"t{t.tier_id}_count").alias("object_count"), F.col(f"t{t.tier_id}_bytes").alias("bytes")).alias("value")) for t in TIERS])
    kept = F.filter(entries, lambda e: (e["value"]["object_count"] > 0) | (e["value"]["bytes"] > 0))
    return nodes.select("prefix", F.map_from_entries(kept).alias("tiers"))
