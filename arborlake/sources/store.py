"""The stored index: a node table in Parquet, with a manifest and a list of tiers beside it.

Nodes are partitioned by depth and sorted by prefix, so that a look-up, whose depth is the number of
slashes it has, reads one partition and skips row groups by the prefix' least and largest value. Small
indexes are one sorted table, as many small files would cost more than they save.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions.tiers import TIERS
from arborlake.operators import navigation as nav
from arborlake.operators import tier_breakdown
from arborlake.operators.rollup import TIER_COLUMNS, TOTALS

VERSION = 1
#: From so many nodes on, the table is partitioned by depth.
PARTITION_FROM = 100_000
#: Nodes of a file at most: files stay far below the 2 GB that a checksum can take at once.
NODES_A_FILE = 1_000_000
#: A bloom filter on the prefix lets look-ups of what isn't there, or is scattered, skip row groups.
FILE_OPTIONS = {"maxRecordsPerFile": str(NODES_A_FILE), "parquet.bloom.filter.enabled#prefix": "true"}


class StoreError(RuntimeError):
    """An index that is incomplete, of another version, or changed since it was written."""


def node_schema(tiers: bool) -> T.StructType:
    long, kinds = T.LongType(), {"prefix": T.StringType(), "depth": T.IntegerType(), "max_depth_in_subtree": T.IntegerType()}
    names = ["prefix", "depth", "pos", "subtree_end", "max_depth_in_subtree", *TOTALS, *(TIER_COLUMNS if tiers else [])]
    return T.StructType([T.StructField(n, kinds.get(n, long)) for n in names])


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file to any file system that Spark writes."""
    fs, jpath = _fs(spark, path)
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _get(spark: SparkSession, path: str) -> str:
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        raise StoreError(f"{path} is missing")
    return spark.read.text(path, wholetext=True).first()[0]


def checksums(spark: SparkSession, path: str) -> dict[str, dict]:
    """Size and SHA-256 of every data file, computed by Spark where the files are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/nodes")
    rows = files.select(F.substring_index("path", "/nodes/", -1).alias("name"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("checksum"))
    return {r["name"]: {"size": r["size"], "checksum": r["checksum"]} for r in rows.collect()}


def write_index(nodes: DataFrame, path: str, *, partition: bool | None = None) -> dict:
    """Writes nodes, ``manifest.json`` and ``tiers.json``; returns the manifest. The manifest comes last,
    so that a directory without one is no index."""
    spark = nodes.sparkSession
    tiers = tier_breakdown.has_tiers(nodes)
    total = nodes.count()
    by_depth = total >= PARTITION_FROM if partition is None else partition
    ordered = nodes.select(*node_schema(tiers).names)
    if by_depth:
        ordered = ordered.repartitionByRange("depth", "prefix").sortWithinPartitions("depth", "prefix")
        ordered.write.options(**FILE_OPTIONS).mode("overwrite").partitionBy("depth").parquet(f"{path}/nodes")
    else:
        ordered.orderBy("depth", "prefix").write.options(**FILE_OPTIONS).mode("overwrite").parquet(f"{path}/nodes")
    info = nav.summary(nodes).first()
    names = {r["tier_id"] for r in tier_breakdown.present_tiers(nodes).collect()} if tiers and total else set()
    present = [{"id": t.tier_id, "name": t.tier_name, "file": t.column} for t in TIERS if t.tier_id in names]
    listing = json.dumps({"tiers": present}, indent=2)
    put_text(spark, f"{path}/tiers.json", listing)
    files = checksums(spark, path)
    files["../tiers.json"] = {"size": len(listing), "checksum": hashlib.sha256(listing.encode()).hexdigest()}
    manifest = {"version": VERSION, "created_at": datetime.datetime.now(datetime.UTC).isoformat(), "node_count": info["node_count"], "max_depth": info["max_depth"], "tiers": tiers, "partitioned": by_depth, "files": files}
    put_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=2))
    return manifest


def verify(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with the stored files, as compared with the manifest; empty if nothing is."""
    manifest = json.loads(_get(spark, f"{path}/manifest.json"))
    there = checksums(spark, path)
    listing = _get(spark, f"{path}/tiers.json")
    there["../tiers.json"] = {"size": len(listing), "checksum": hashlib.sha256(listing.encode()).hexdigest()}
    wrong = [f"{name} is missing" for name in manifest["files"] if name not in there]
    wrong += [f"{name} isn't in the manifest" for name in there if name not in manifest["files"]]
    return wrong + [f"{name} has changed" for name, want in manifest["files"].items() if name in there and there[name] != want]


@dataclass
class Index:
    """An opened index. All methods that find nodes return lazy DataFrames."""

    nodes: DataFrame
    manifest: dict
    tiers: list[dict]
    path: str = ""

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        manifest = json.loads(_get(spark, f"{path}/manifest.json"))
        if manifest.get("version") != VERSION:
            raise StoreError(f"version {manifest.get('version')} isn't supported")
        listing = json.loads(_get(spark, f"{path}/tiers.json"))["tiers"]
        nodes = spark.read.schema(node_schema(manifest["tiers"])).parquet(f"{path}/nodes")
        return cls(nodes, manifest, listing, path)

    @property
    def count(self) -> int:
        return self.manifest["node_count"]

    @property
    def max_depth(self) -> int:
        return self.manifest["max_depth"]

    @property
    def has_tiers(self) -> bool:
        return bool(self.tiers)

    def lookup(self, prefix: str) -> DataFrame:
        return nav.lookup(self.nodes, prefix)

    def stats(self, prefix: str) -> tuple[int, int] | None:
        """(objects, bytes) of a prefix, or None."""
        row = self.lookup(prefix).select(*TOTALS).first()
        return tuple(row) if row else None

    def prefix(self, pos: int) -> str:
        return nav.prefix_of(self.nodes, pos)

    def descendants(self, prefix: str, rel_depth: int, min_count: int = 0, min_bytes: int = 0) -> DataFrame:
        """In order of position."""
        return nav.in_order(nav.descendants_at(self.nodes, prefix, rel_depth, min_count, min_bytes))

    def descendants_up_to(self, prefix: str, max_rel_depth: int) -> DataFrame:
        """Depth by depth, each in order of position."""
        return nav.in_order(nav.descendants_up_to(self.nodes, prefix, max_rel_depth), by_depth=True)

    def prefixes(self) -> DataFrame:
        """(pos, prefix) of all nodes, in order."""
        return nav.prefixes_in_order(self.nodes)

    def iterate(self, prefix: str, rel_depth: int):
        return nav.iterate(self.descendants(prefix, rel_depth))

    def breakdown(self, prefix: str) -> list[tuple[str, int, int]]:
        """(tier, objects, bytes) of the non-empty tiers at a prefix, by tier id."""
        if not self.has_tiers:
            return []
        return [(r["tier_name"], r["object_count"], r["bytes"]) for r in tier_breakdown.breakdown_for(self.nodes, prefix).collect()]
