"""Inventory manifests: parsing, validation, formats, columns, bucket names and object addresses."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import SparkSession


class ManifestError(ValueError):
    """A manifest, bucket name or address that can't be used."""


class Format(Enum):
    CSV = "CSV"
    PARQUET = "Parquet"


@dataclass(frozen=True)
class ManifestFile:
    key: str
    size: int = 0
    md5: str = ""


@dataclass(frozen=True)
class Manifest:
    destination_bucket: str
    files: tuple[ManifestFile, ...]
    file_format: str = ""
    file_schema: str = ""
    source_bucket: str = ""
    version: str = ""
    creation_timestamp: str = ""
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def format(self) -> Format:
        """The stated format, else by the first file's suffix, else CSV."""
        stated = self.file_format.strip().upper()
        if stated:
            return Format.PARQUET if stated == "PARQUET" else Format.CSV
        first = self.files[0].key.lower() if self.files else ""
        return Format.PARQUET if first.endswith(".parquet") else Format.CSV

    @property
    def columns(self) -> list[str]:
        """Column names of the file schema, in lower case."""
        return [c.strip().lower() for c in self.file_schema.split(",")]

    def _index(self, name: str) -> int:
        columns = self.columns
        return columns.index(name) if name in columns else -1

    def _required(self, name: str) -> int:
        at = self._index(name.lower())
        if at < 0:
            raise ManifestError(f"column {name} isn't in the file schema {self.file_schema!r}")
        return at

    @property
    def key_column(self) -> int:
        return self._required("Key")

    @property
    def size_column(self) -> int:
        return self._required("Size")

    @property
    def storage_class_column(self) -> int:
        return self._index("storageclass")

    @property
    def access_tier_column(self) -> int:
        return self._index("intelligenttieringaccesstier")

    @property
    def bucket(self) -> str:
        return bucket_name(self.destination_bucket)


def parse_manifest(text: str | bytes) -> Manifest:
    """A manifest from JSON; ManifestError for bad JSON, no destination, no files or another format."""
    try:
        raw = json.loads(text)
        if not isinstance(raw, dict):
            raise TypeError("not an object")
        files = tuple(ManifestFile(f["key"], int(f.get("size") or 0), f.get("MD5checksum") or "") for f in raw.get("files") or [])
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise ManifestError(f"a manifest must be a JSON object with files: {e}") from e
    known = {"destinationBucket", "files", "fileFormat", "fileSchema", "sourceBucket", "version", "creationTimestamp"}
    get = lambda k: str(raw.get(k) or "")
    manifest = Manifest(get("destinationBucket"), files, get("fileFormat"), get("fileSchema"), get("sourceBucket"), get("version"), get("creationTimestamp"), {k: v for k, v in raw.items() if k not in known})
    if not manifest.destination_bucket:
        raise ManifestError("destinationBucket is missing")
    if not files:
        raise ManifestError("the manifest lists no files")
    if manifest.file_format.strip().upper() not in ("", "CSV", "PARQUET"):
        raise ManifestError(f"unsupported fileFormat {manifest.file_format!r}")
    return manifest


def bucket_name(identifier: str) -> str:
    """The bucket of a plain name or a resource name ``arn:<partition>:s3:::name``."""
    if not identifier:
        raise ManifestError("the bucket name is empty")
    if "://" in identifier:
        raise ManifestError(f"{identifier!r} is an address, not a bucket name")
    if identifier.startswith("arn:"):
        parts = identifier.split(":", 5)
        if len(parts) < 6 or parts[2] != "s3" or not parts[5]:
            raise ManifestError(f"{identifier!r} names no bucket")
        identifier = parts[5]
    name = identifier.partition("/")[0]
    if not name:
        raise ManifestError(f"{identifier!r} names no bucket")
    return name


def parse_address(address: str) -> tuple[str, str]:
    """(bucket, key) of ``s3://bucket/key``; the key may be empty."""
    m = re.fullmatch(r"s3://([^/]+)/?(.*)", address, re.DOTALL)
    if not m:
        raise ManifestError(f"{address!r} isn't of the form s3://bucket/key")
    return m[1], m[2]


def fetch_manifest(spark: SparkSession, path: str) -> Manifest:
    """A manifest from any file system that Spark reads."""
    return parse_manifest(spark.read.text(_readable(path), wholetext=True).first()[0])


def _readable(path: str) -> str:
    """Hadoop's connector for object stores goes by the scheme s3a."""
    return "s3a" + path[2:] if path.startswith("s3://") else path


def file_paths(manifest: Manifest, root: str | None = None) -> list[str]:
    """Paths of the inventory files: in the destination bucket, or below ``root`` if given."""
    base = root.rstrip("/") if root else f"s3a://{manifest.bucket}"
    return [f"{base}/{f.key.lstrip('/')}" for f in manifest.files]
