"""Inventory scans: CSV with or without a header, gzip, and Parquet, as one canonical DataFrame
(key string, size bigint, storage_class string, access_tier string).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions.sizes import size_expr
from arborlake.functions.tiers import tier_id
from arborlake.sources.manifest import Format, Manifest, ManifestError, file_paths

#: Canonical columns and their names in CSV headers and in Parquet files.
CSV_NAMES = {"key": "key", "size": "size", "storage_class": "storageclass", "access_tier": "intelligenttieringaccesstier"}
PARQUET_NAMES = {"key": "key", "size": "size", "storage_class": "storage_class", "access_tier": "intelligent_tiering_access_tier"}
CANONICAL = ("key", "size", "storage_class", "access_tier")


def _csv_options(header: bool) -> dict[str, str]:
    # Doubled quotes are quotes, line ends inside quotes are text, and nothing is trimmed.
    return {"header": str(header).lower(), "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "enforceSchema": "true", "nullValue": "\x00", "emptyValue": ""}


def _fields(raw: Column) -> Column:
    """Number of fields of a raw record: separators outside quotes, and one."""
    outside = F.regexp_replace(raw, '(?s)"(?:[^"]|"")*"', "")
    return F.regexp_count(outside, F.lit(",")) + 1


def scan_csv(spark: SparkSession, paths: list[str], columns: dict[str, int], width: int, *, header: bool = False) -> DataFrame:
    """CSV files by position: ``columns`` maps canonical names to places in records of ``width`` fields.

    Records with too few fields for key or size, or with an empty key, are skipped; invalid sizes are 0;
    further fields are ignored, missing optional ones empty. Files ending in .gz are unpacked; such a file
    is one task, so the rows are dealt out anew when there are fewer files than cores.
    """
    at = {columns[c]: c for c in CANONICAL if columns.get(c, -1) >= 0}
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    raw = spark.read.schema(T.StructType([*fields, T.StructField("_raw", T.StringType())])).options(**_csv_options(header)).csv(paths)
    if any(p.lower().endswith(".gz") for p in paths) and len(paths) < spark.sparkContext.defaultParallelism:
        raw = raw.repartition(spark.sparkContext.defaultParallelism)
    need = max(columns["key"], columns["size"]) + 1
    size = F.col(f"c{columns['size']}")
    # A missing field and an empty one both read as null; only records of another length keep their raw text.
    long_enough = size.isNotNull() | F.col("_raw").isNull() | (_fields(F.col("_raw")) >= need)
    own = {name: F.coalesce(F.col(f"c{i}"), F.lit("")) for i, name in at.items()}
    rows = raw.where(long_enough)
    out = rows.select(own["key"].alias("key"), size_expr(size).alias("size"), *[own.get(c, F.lit("")).alias(c) for c in CANONICAL[2:]])
    return out.where(F.col("key") != "")


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file with a header, trimmed, in lower case."""
    return [c.strip().lower() for c in spark.read.options(header="true", quote='"', escape='"').csv(path).columns]


def read_csv_with_header(spark: SparkSession, paths: list[str], *, track_tiers: bool = True) -> DataFrame:
    """CSV files that begin with a header; a header without key or size is an error."""
    names = read_header(spark, paths[0])
    at = {c: names.index(n) if n in names else -1 for c, n in CSV_NAMES.items()}
    for c in ("key", "size"):
        if at[c] < 0:
            raise ManifestError(f"the header has no column {c}")
    if not track_tiers:
        at["storage_class"] = at["access_tier"] = -1
    return scan_csv(spark, paths, at, len(names), header=True)


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files; the column names are exact. Null keys drop out, null sizes are 0.

    A negative size is no size: it raises an error rather than being read as a huge unsigned number.
    """
    raw = spark.read.parquet(*paths)
    names = set(raw.columns)
    for c in ("key", "size"):
        if c not in names:
            raise ManifestError(f"the Parquet schema has no column {c}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in names else F.lit("")
    size = F.coalesce(F.col("size").cast("bigint"), F.lit(0).cast("bigint"))
    checked = F.when(size < 0, F.raise_error(F.concat(F.lit("negative size of "), F.col("key"))).cast("bigint")).otherwise(size)
    out = raw.select(text("key").alias("key"), checked.alias("size"), *[text(PARQUET_NAMES[c]).alias(c) for c in CANONICAL[2:]])
    return out.where(F.col("key") != "")


def read_inventory(spark: SparkSession, manifest: Manifest, root: str | None = None) -> DataFrame:
    """All files of a manifest. Key and Size must be in the file schema for either format."""
    columns = {"key": manifest.key_column, "size": manifest.size_column, "storage_class": manifest.storage_class_column, "access_tier": manifest.access_tier_column}
    paths = file_paths(manifest, root)
    if manifest.format is Format.PARQUET:
        return read_parquet(spark, paths)
    return scan_csv(spark, paths, columns, len(manifest.columns))


def with_tiers(rows: DataFrame) -> DataFrame:
    """Canonical rows as objects: (key, size, tier_id)."""
    return rows.select("key", "size", tier_id(F.col("storage_class"), F.col("access_tier")).alias("tier_id"))
