"""Look-ups and walks in a node table (see :mod:`arborlake.operators.numbering`).

All functions are lazy and return nodes; what misses is an empty DataFrame. Predicates are plain
comparisons with literals, so that they reach a stored table's scan: equality and "starts with" on the
prefix, equality and ranges on the depth.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.prefixes import prefix_depth


def lookup(nodes: DataFrame, prefix: str) -> DataFrame:
    """The node of exactly this prefix: case and the trailing slash matter; "" is the root."""
    return nodes.where((F.col("depth") == prefix.count("/")) & (F.col("prefix") == prefix))


def lookup_many(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Nodes of all prefixes in a column ``prefix``; misses drop out. Joined on the depth too, by which stored
    nodes are partitioned, so that depths nobody asks for needn't be read."""
    asked = prefixes.select("prefix").where(F.col("prefix").isNotNull()).distinct()
    return asked.withColumn("depth", prefix_depth(F.col("prefix"))).join(nodes, ["depth", "prefix"])


def at_position(nodes: DataFrame, pos: int) -> DataFrame:
    return nodes.where(F.col("pos") == pos)


def prefix_of(nodes: DataFrame, pos: int) -> str:
    """The prefix at a position; IndexError outside the table."""
    row = at_position(nodes, pos).select("prefix").first()
    if row is None:
        raise IndexError(f"position {pos} is outside the index")
    return row[0]


def at_depth(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.where(F.col("depth") == depth)


def descendants_at(nodes: DataFrame, prefix: str, rel_depth: int, min_count: int = 0, min_bytes: int = 0) -> DataFrame:
    """Nodes exactly ``rel_depth`` below ``prefix``; 0 is the node itself, negative depths give none.
    Thresholds are inclusive. Order by prefix where order matters."""
    if rel_depth < 0 or (prefix and not prefix.endswith("/")):
        return nodes.where(F.lit(False))
    inside = nodes.where(F.col("depth") == prefix.count("/") + rel_depth)
    if prefix:
        inside = inside.where(F.col("prefix").startswith(prefix))
    return above(inside, min_count, min_bytes)


def descendants_up_to(nodes: DataFrame, prefix: str, max_rel_depth: int) -> DataFrame:
    """Nodes 1 to ``max_rel_depth`` below ``prefix``, with ``rel_depth``; the node itself isn't one."""
    base = prefix.count("/")
    if prefix and not prefix.endswith("/"):
        return nodes.where(F.lit(False)).withColumn("rel_depth", F.col("depth") - base)
    inside = nodes.where(F.col("depth").between(base + 1, base + max_rel_depth))
    if prefix:
        inside = inside.where(F.col("prefix").startswith(prefix))
    return inside.withColumn("rel_depth", F.col("depth") - base)


def all_descendants(nodes: DataFrame, prefix: str) -> DataFrame:
    """Every node below ``prefix``, without itself."""
    if prefix and not prefix.endswith("/"):
        return nodes.where(F.lit(False))
    return nodes.where((F.col("depth") > prefix.count("/")) & F.col("prefix").startswith(prefix))


def above(nodes: DataFrame, min_count: int = 0, min_bytes: int = 0) -> DataFrame:
    """Nodes of at least so many objects and bytes; 0 asks nothing."""
    if min_count:
        nodes = nodes.where(F.col("object_count") >= min_count)
    if min_bytes:
        nodes = nodes.where(F.col("total_bytes") >= min_bytes)
    return nodes


def in_order(found: DataFrame, *, by_depth: bool = False) -> DataFrame:
    """Found nodes in order of position, that is of prefix; with ``by_depth``, depth by depth."""
    return found.orderBy("depth", "pos") if by_depth else found.orderBy("pos")


def prefixes_in_order(nodes: DataFrame) -> DataFrame:
    """(pos, prefix) of all nodes by position."""
    return in_order(nodes).select("pos", "prefix")


def iterate(found: DataFrame) -> Iterator:
    """Found nodes one by one, in order of position, a partition at a time on the driver."""
    return found.orderBy("pos").toLocalIterator()


def summary(nodes: DataFrame) -> DataFrame:
    """One row: node_count, max_depth, and the root's object_count and total_bytes."""
    root = F.col("depth") == 0
    return nodes.agg(
        F.count("*").alias("node_count"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.coalesce(F.sum(F.when(root, F.col("object_count"))), F.lit(0).cast("long")).alias("object_count"),
        F.coalesce(F.sum(F.when(root, F.col("total_bytes"))), F.lit(0).cast("long")).alias("total_bytes"),
    )


def largest(nodes: DataFrame, k: int, by: str = "total_bytes", depth: int | None = None) -> DataFrame:
    """The ``k`` largest nodes, of one depth if given; ties go by prefix."""
    nodes = nodes if depth is None else at_depth(nodes, depth)
    return nodes.orderBy(F.desc(by), "prefix").limit(k)


def broken_ranges(nodes: DataFrame) -> DataFrame:
    """Nodes that break an invariant: a position beyond the subtree's end, a range outside the table, a
    depth that isn't the number of slashes, or a subtree shallower than its root. Empty if all is well."""
    size = nodes.count()
    wrong = (F.col("pos") > F.col("subtree_end")) | (F.col("subtree_end") >= size) | (F.col("depth") != prefix_depth(F.col("prefix"))) | (F.col("max_depth_in_subtree") < F.col("depth"))
    return nodes.where(F.coalesce(wrong, F.lit(True)))
