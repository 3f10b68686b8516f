"""Uniform shuffling into shards of exact size by a hypergeometric communication matrix.

Rows lie in logical partitions. How many of partition p's rows go to shard s is not left to a
per-row coin: the whole matrix is drawn first, row by row, from the multivariate hypergeometric
law, which is the exact law of those counts under a uniform permutation with the given shard
sizes. Then each partition permutes its rows locally and cuts them at the matrix' cumulative
counts, the rows are exchanged, and each shard permutes again (Sanders 1998; Gustedt 2008).

No shard is ever in one task: the second permutation ranks rows by a 64-bit key in key blocks
of bounded size, and since that key depends only on (partition, place), the blocks' offsets
follow from the partitions' counts without another look at the documents.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.common import free_name, small_table


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One exact draw: how many of ``draws`` balls, taken without replacement, are good.

    Inversion that walks outwards from the mode, so that it needs about as many steps as the
    standard deviation and never a table of the whole support.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) / (up + 1) * (draws - up) / (bad - draws + up + 1)
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down / (good - down + 1) * (bad - draws + down) / (draws - down + 1)
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode if u > 0 else up


def communication_matrix(counts: list[int], capacities: list[int], seed: int) -> list[list[int]]:
    """Rows sum to ``counts``, columns to ``capacities``; drawn from the exact joint law."""
    rng = random.Random(seed)
    left = list(capacities)
    matrix = []
    for n in counts:
        row, rest = [], sum(left)
        for s, room in enumerate(left):
            rest -= room
            x = hypergeometric(rng, room, rest, n) if n else 0
            row.append(x)
            left[s] -= x
            n -= x
        matrix.append(row)
    return matrix


def shuffle_into_shards(
    docs: DataFrame,
    shards: int = 8,
    *,
    seed: int = 20_011,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_partition: int = 4_096,
    max_partitions: int = 65_536,
    max_blocks: int = 8_192,
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: a uniform shuffle under which shards' row counts are
    at most one apart and slots count from 0 without gaps.

    All columns are kept (a column of ``docs`` named ``shard`` or ``slot`` gets replaced). Rows are
    equal partners: null ids, null or empty texts, repeated ids and repeated rows each hold a slot
    of their own. An empty table gives no rows. The same rows, seed and parameters give the same
    shards. The driver holds one count per logical partition (``max_partitions`` at most) and draws
    the matrix; offsets are broadcast, ``shards * max_blocks`` rows at most.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    pid, place, key, cuts, block, offset = free_name(docs, "pid", "place", "key", "cuts", "block", "offset")
    total = docs.count()
    parts = min(max_partitions, max(16, math.ceil(total / rows_per_partition)))
    seeded = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    placed = docs.withColumn(key, seeded).withColumn(pid, F.pmod(F.shiftrightunsigned(key, 7), F.lit(parts)).cast("int"))

    counts = {r[0]: r[1] for r in placed.groupBy(pid).count().collect()}
    sizes = [counts.get(p, 0) for p in range(parts)]
    capacities = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(sizes, capacities, seed)
    ends = []
    for row in matrix:
        at, cum = 0, []
        for x in row:
            at += x
            cum.append(at)
        ends.append(cum)
    table = small_table(spark, [{"p": p, "n": sizes[p], "c": c} for p, c in enumerate(ends)], "p:int,n:bigint,c:array<bigint>")
    where = F.size(F.filter(F.col(cuts), lambda c: c <= F.col(place)))

    # Local permutation. The first ranking gives copies of a row places of their own, the second
    # one is the permutation; both need the same exchange.
    lot = F.xxhash64(F.lit(seed + 1), F.col(pid), F.col(place))
    ranked = placed.withColumn(place, F.row_number().over(Window.partitionBy(pid).orderBy(key, id_col)).cast("long"))
    ranked = ranked.withColumn(key, lot)
    ranked = ranked.withColumn(place, F.row_number().over(Window.partitionBy(pid).orderBy(key, place)).cast("long") - 1)
    cut = table.select(F.col("p").alias(pid), F.col("c").alias(cuts))
    dealt = ranked.join(F.broadcast(cut), pid).withColumn("shard", where)

    # Second permutation, by a key of (partition, place), in blocks of its leading bits.
    bits = min(max(0, math.ceil(math.log2(max(1, total / shards / rows_per_partition)))), int(math.log2(max_blocks)))
    lot = F.xxhash64(F.lit(seed + 2), F.col(pid), F.col(place))
    lead = F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)
    dealt = dealt.drop(cuts).withColumn(key, lot).withColumn(block, lead)
    # Slots are generated by many tasks, none of which makes more than about a million.
    spread_over = min(4_096, -(-total // 1_000_000))
    own = table.where("n > 0")
    own = own.repartition(spread_over, "p") if spread_over > 1 else own
    places = own.select(F.col("p").alias(pid), F.col("c").alias(cuts), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias(place))
    spread = places.withColumn("shard", where).withColumn(key, lot).withColumn(block, lead).groupBy("shard", block).agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    offsets = spread.select("shard", block, F.coalesce(before, F.lit(0)).alias(offset))
    inside = F.row_number().over(Window.partitionBy("shard", block).orderBy(key, pid, place)).cast("long") - 1
    out = dealt.withColumn("slot", inside).join(F.broadcast(offsets), ["shard", block])
    return out.select(*docs.columns, F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col(offset)).alias("slot"))
