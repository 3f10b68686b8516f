"""From a manifest to a stored index."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from arborlake.operators.numbering import number_nodes
from arborlake.operators.rollup import rollup
from arborlake.sources.inventory import read_inventory, with_tiers
from arborlake.sources.manifest import fetch_manifest
from arborlake.sources.store import write_index


@dataclass(frozen=True)
class BuildResult:
    files: int
    objects: int
    prefixes: int
    max_depth: int
    seconds: float


def build_nodes(objects: DataFrame, *, tiers: bool = True, max_depth: int = 0, ranges: int | None = None) -> DataFrame:
    """The node table of objects (key, size[, tier_id])."""
    return number_nodes(rollup(objects, tiers=tiers, max_depth=max_depth), ranges)


def build_index(spark: SparkSession, manifest_path: str, out: str, *, root: str | None = None, max_depth: int = 0) -> BuildResult:
    """Reads the manifest's inventory files, rolls them up and writes the index to ``out``."""
    began = time.monotonic()
    manifest = fetch_manifest(spark, manifest_path)
    nodes = build_nodes(with_tiers(read_inventory(spark, manifest, root)), max_depth=max_depth).persist()
    try:
        written = write_index(nodes, out)
        top = nodes.where("depth = 0").select("object_count").first()
    finally:
        nodes.unpersist()
    return BuildResult(len(manifest.files), top[0] if top else 0, written["node_count"], written["max_depth"], time.monotonic() - began)
