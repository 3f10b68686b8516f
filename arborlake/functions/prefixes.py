"""Prefixes of slash-separated keys.

A key's prefixes are the root "" and everything up to and with each of its slashes. A prefix of
depth d holds d slashes, so that depth and ancestors follow from the text alone, and, as every
prefix but the root ends in a slash, "is an ancestor of" is "is a string prefix of".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slash_count(key: Column) -> Column:
    return (F.octet_length(key) - F.octet_length(F.replace(key, F.lit("/"), F.lit("")))).cast("int")


def prefix_depth(prefix: Column) -> Column:
    return slash_count(prefix)


def prefix_at(key: Column, depth: Column) -> Column:
    """The key's prefix with ``depth`` slashes; the key has so many at least."""
    return F.when(depth == 0, F.lit("")).otherwise(F.concat(F.substring_index(key, "/", depth) if isinstance(depth, int) else F.call_function("substring_index", key, F.lit("/"), depth), F.lit("/")))


def capped_depth(key: Column, max_depth: int = 0) -> Column:
    """Depth of the key's directory, cut at ``max_depth`` where that is above 0."""
    return F.least(slash_count(key), F.lit(max_depth)) if max_depth > 0 else slash_count(key)


def parent_dir(key: Column, max_depth: int = 0) -> Column:
    """The deepest prefix of a key, after the cut: "" for a key without slashes."""
    return prefix_at(key, capped_depth(key, max_depth))


def prefix_array(key: Column, max_depth: int = 0) -> Column:
    """Array of (depth, prefix), from the root down."""
    return F.transform(F.sequence(F.lit(0), capped_depth(key, max_depth)), lambda d: F.struct(d.alias("depth"), prefix_at(key, d).alias("prefix")))


def extract_prefixes(key: str) -> list[str]:
    """The prefixes of one key, without the root."""
    return [key[: i + 1] for i, c in enumerate(key) if c == "/"]
