"""Mixing sources to target weights as a min-cost flow with convex repetition costs.

A text may stand in several sources. Documents are aggregated by membership pattern: the set of sources
in which their text occurs. A flow network then routes words from patterns to sources, each of which wants
its target. A pattern's words cost nothing as long as each text is taken once, in whichever source, more
where a text is taken again through another copy, and more again where a document is repeated; so the
cheapest full flow repeats as little as the targets allow. Documents are selected by a seeded order: those
of a pattern and source whose key lies behind the source's begin on a circle of keys, up to the cut where
the words sum up to the flow; the sources of a pattern begin one behind the other, so that they take
different texts. The cut is found in two steps over key blocks, so no source is ever in one task.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.common import bit_map, blank_words, free_name, in_bit_map, join_hot, small_table, written

#: Fixed values of the weighting rule: weights repeat over the ordered sources.
WEIGHTS = (5, 2, 1)
#: Bits of a key on the circle, and of the map of texts that stand in several sources.
KEY_BITS, MAP_BITS = 62, 1 << 20


def source_targets(sizes: dict[str | None, int], *, share: Fraction = Fraction(3, 2), most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, Fraction]:
    """Targets in words: ``share`` of all sizes dealt out by weight; none over ``most`` times its
    source's size, what is over being dealt again to the rest until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, Fraction] = {}
    left, free = share * sum(sizes.values()), list(order)
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / whole for s in free}
            break
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


class Network:
    """A flow network with integral capacities and small integral costs."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, u: int, v: int, room: int, cost: int) -> int:
        """The number of a new arc; its reverse is the next number."""
        for a, b, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def fill(self, source: int, sink: int) -> None:
        """A largest flow of least cost: for every distance from source to sink, of which there are few as
        costs are small, the largest flow along shortest paths (primal-dual)."""
        potential = [0] * len(self.out)
        while True:
            distance = self._distances(source, potential)
            if distance[sink] == math.inf:
                return
            potential = [p + min(d, distance[sink]) for p, d in zip(potential, distance, strict=True)]
            while level := self._levels(source, sink, potential):
                self._block(source, sink, potential, level)

    def _distances(self, source: int, potential: list[int]) -> list[float]:
        distance: list[float] = [math.inf] * len(self.out)
        distance[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            for a in self.out[u]:
                v = self.to[a]
                nd = d + self.cost[a] + potential[u] - potential[v]
                if self.room[a] > 0 and nd < distance[v]:
                    distance[v] = nd
                    heapq.heappush(heap, (nd, v))
        return distance

    def _tight(self, a: int, u: int, potential: list[int]) -> bool:
        return self.room[a] > 0 and self.cost[a] + potential[u] == potential[self.to[a]]

    def _levels(self, source: int, sink: int, potential: list[int]) -> list[int] | None:
        level = [-1] * len(self.out)
        level[source], queue = 0, [source]
        for u in queue:
            for a in self.out[u]:
                if level[self.to[a]] < 0 and self._tight(a, u, potential):
                    level[self.to[a]] = level[u] + 1
                    queue.append(self.to[a])
        return level if level[sink] >= 0 else None

    def _block(self, source: int, sink: int, potential: list[int], level: list[int]) -> None:
        """Flow along paths of rising levels, until each has a full arc."""
        at = [0] * len(self.out)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                push = min(self.room[a] for a in path)
                for a in path:
                    self.room[a] -= push
                    self.room[a ^ 1] += push
                first = next(i for i, a in enumerate(path) if not self.room[a])
                u = self.to[path[first] ^ 1]
                del path[first:]
                continue
            while at[u] < len(self.out[u]):
                a = self.out[u][at[u]]
                if level[self.to[a]] == level[u] + 1 and self._tight(a, u, potential):
                    break
                at[u] += 1
            else:
                if not path:
                    return
                u = self.to[path.pop() ^ 1]
                at[u] += 1
                continue
            path.append(a)
            u = self.to[a]


def min_cost_flow(distinct: dict, words: dict, quota: dict, most: int) -> dict[tuple, int]:
    """(pattern, source) -> words, of a largest flow of least cost.

    ``distinct`` are the words of each pattern's distinct texts, ``words`` those of all its documents in
    each of its sources, (pattern, source) -> words. The first ``distinct`` words of a pattern cost nothing, the rest
    of its documents 1, the k-th use of all documents k; of a source's documents the first use costs nothing
    more, further ones 1. A source takes its quota at most.
    """
    patterns, sources = list(distinct), list(quota)
    node = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    net = Network(len(node) + 2)
    whole: dict = {}
    arcs = {}
    for (p, s), w in words.items():
        whole[p] = whole.get(p, 0) + w
        arcs[p, s] = [net.arc(node["p", p], node["s", s], w * uses, cost) for uses, cost in ((1, 0), (most - 1, 1))]
    for p, w in whole.items():
        tiers = [(min(distinct[p], w), 0), (w - min(distinct[p], w), 1), *((w, k) for k in range(2, most + 1))]
        for room, cost in tiers:
            net.arc(0, node["p", p], room, cost)
    for s in sources:
        net.arc(node["s", s], 1, quota[s], 0)
    net.fill(0, 1)
    return {ps: sum(net.room[a ^ 1] for a in own) for ps, own in arcs.items()}


def source_code(source: Column) -> Column:
    """A text for a source; null is a source of its own."""
    return F.when(source.isNull(), "~").otherwise(F.concat(F.lit("="), source))


def _source(code: str) -> str | None:
    return None if code == "~" else code[1:]


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most: int = 2,
    share: Fraction = Fraction(3, 2),
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 7_001,
    rows_per_block: int = 2_048,
    max_patterns: int = 100_000,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``pattern``, ``source_size``, ``target`` and ``copies``; without
    ``keep_text`` the text is left out and no text is read twice.

    ``pattern`` lists the sources in which the document's text occurs; ``source_size`` and ``target`` are
    those of its own source. ``copies`` is 0 to ``most``: how often the mix takes the document, so it takes
    ``size * copies`` of its words. Texts are equal if their 64-bit hashes are.

    A source's words of a pattern come as near the flow as whole documents allow: those up to the cut key
    and one closing document that fits the rest best. Null and empty texts have size 0 and are never taken.
    Rows that agree in id and text share their key, so they are taken alike. An empty table gives no rows.
    Columns named as those added are replaced.

    The driver holds a number per source, and per source of a pattern of several sources; of those there
    are ``max_patterns`` at most: beyond, texts of the patterns of the fewest words count in each of their
    sources as texts of that source alone. Sources still come to their targets; only that such a text is
    not taken in two sources isn't looked after.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "pattern", "source_size", "target", "copies")
    hash_, code, own, key = free_name(docs, "hash", "code", "own", "key")
    rest = [c for c in docs.columns if c != text_col]
    size = F.size(blank_words(F.col(text_col))).cast("long")
    marked = docs.withColumn(hash_, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn(code, source_code(F.col(source_col)))
    marked = marked.withColumn(own, F.xxhash64(F.lit(seed), F.col(id_col), F.col(hash_)))
    narrow = written(marked.withColumn("size", size).drop(text_col), "mixing-sizes")

    texts = narrow.where("size > 0").groupBy(F.col(hash_).alias("h")).agg(F.array_sort(F.collect_set(code)).alias("codes"), F.count("*").alias("n"), F.max("size").alias("size"))
    texts = written(texts, "mixing-texts")
    multi = texts.where(F.size("codes") > 1).withColumn("pattern", F.to_json("codes"))
    patterns = multi.groupBy("pattern").agg(F.sum("size").alias("distinct")).orderBy(F.desc("distinct"), "pattern").limit(max_patterns)
    patterns = written(patterns, "mixing-patterns")
    distinct = {r["pattern"]: r["distinct"] for r in patterns.collect()}
    multi = multi.join(F.broadcast(patterns.select("pattern")), "pattern", "left_semi")
    single = texts.join(multi.select("h"), "h", "left_anti").select(F.explode("codes").alias("code"), "size").groupBy("code").agg(F.sum("size").alias("distinct"))
    distinct |= {json.dumps([r["code"]], ensure_ascii=False): r["distinct"] for r in single.collect()}

    # Texts of one row in each source share a key there, so that the sources can take different ones.
    table = multi.select(F.col("h").alias(hash_), "pattern", (F.col("n") == F.size("codes")).alias("alike"), "n")
    map_ = bit_map(multi.select("h"), MAP_BITS)

    def with_pattern(df: DataFrame) -> DataFrame:
        may = in_bit_map(map_, F.col(hash_), MAP_BITS)
        found = df.where(~may).select("*", F.lit(None).cast("string").alias("pattern"), F.lit(False).alias("alike"))
        found = found.unionByName(join_hot(df.where(may), table, hash_, "n"))
        drawn = F.when(F.col("alike"), F.xxhash64(F.lit(seed + 1), F.col(hash_))).otherwise(F.col(own))
        found = found.withColumn("pattern", F.coalesce("pattern", F.to_json(F.array(code)))).withColumn(key, F.shiftrightunsigned(drawn, 64 - KEY_BITS))
        return found.drop("alike", own, hash_)

    placed = written(with_pattern(narrow), "mixing-places")
    summed = placed.groupBy("pattern", F.col(code).alias("code")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    words = {(r["pattern"], r["code"]): r["size"] for r in summed}
    sizes: dict[str | None, int] = {}
    for (_, c), w in words.items():
        sizes[_source(c)] = sizes.get(_source(c), 0) + w
    target = source_targets(sizes, share=share, most=most, weights=weights)
    some = {ps: w for ps, w in words.items() if w}
    flow = min_cost_flow({p: distinct[p] for p, _ in some}, some, {c: round(target[_source(c)]) for _, c in words}, most)
    plan = _plan(words, flow)
    counts = {(r["pattern"], r["code"]): r["n"] for r in summed}
    narrow = placed.select("pattern", F.col(code).alias("code"), "size", F.col(key).alias("key"))
    alone = {c: (json.dumps([c], ensure_ascii=False), c) for _, c in words}
    cuts = _cuts(narrow, {ps: how for ps, how in plan.items() if alone[ps[1]] != ps}, counts, rows_per_block)
    # What whole documents of shared texts leave open or take too much, the source's own texts make up for.
    for ps, (_, _, over) in cuts.items():
        own_texts = alone[ps[1]]
        if words.get(own_texts):
            flow[own_texts] = min(max(0, flow.get(own_texts, 0) - over), most * words[own_texts])
    plan = _plan(words, flow)
    cuts |= _cuts(narrow, {ps: how for ps, how in plan.items() if alone[ps[1]] == ps}, counts, rows_per_block)

    rows = []
    for (p, c), (uses, begin, _) in plan.items():
        cut, closing, _ = cuts.get((p, c), (-1, None, 0))
        rows.append({"pattern": p, "code": c, "source_size": sizes[_source(c)], "target": float(target[_source(c)]), "uses": uses, "begin": begin, "cut": cut, "closing": closing})
    steps = small_table(spark, rows, "pattern:string,code:string,source_size:bigint,target:double,uses:int,begin:bigint,cut:bigint,closing:bigint")
    out = with_pattern(marked.withColumn("size", size)) if keep_text else placed
    out = out.join(F.broadcast(steps.withColumnRenamed("code", code)), ["pattern", code], "left")
    place = _place(F.col(key), F.col("begin"))
    copies = F.col("uses") + (place <= F.col("cut")).cast("int") + F.coalesce((place == F.col("closing")).cast("int"), F.lit(0))
    holds = F.regexp_like(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]")) if keep_text else F.col("size") > 0
    return out.select(*(docs.columns if keep_text else rest), "size", "pattern", "source_size", "target", F.when(holds, copies).otherwise(0).cast("int").alias("copies"))


def _place(key: Column, begin: Column) -> Column:
    """A key's place on the circle, counted from ``begin``."""
    return F.pmod(key - begin, F.lit(1 << KEY_BITS))


def _plan(words: dict, flow: dict) -> dict[tuple, tuple[int, int, int]]:
    """(pattern, source) -> (uses of every document, begin on the circle, words of one further use)."""
    plan, end = {}, {}
    for p, c in sorted(words):
        w = words[p, c]
        uses, rest = divmod(flow.get((p, c), 0), w) if w else (0, 0)
        begin = end.get(p, Fraction(0))
        plan[p, c] = (uses, int(begin * (1 << KEY_BITS)), rest)
        end[p] = (begin + Fraction(rest, w or 1)) % 1
    return plan


def _cuts(rows: DataFrame, plan: dict, counts: dict, rows_per_block: int) -> dict[tuple, tuple[int, int | None, int]]:
    """(pattern, source) -> (cut, closing place or None, words over): the words of the places up to the cut,
    with the closing document's, come nearest to the wanted number; they are so many over it, or under.

    A block is the leading bits of a place. First the blocks' sums, then the rows of the one block in which
    the wanted number is reached.
    """
    spark = rows.sparkSession
    part = [(p, c, begin, x) for (p, c), (_, begin, x) in plan.items() if x]
    if not part:
        return {}
    bits = min(20, max(1, math.ceil(math.log2(max(2, max(counts[p, c] for p, c, _, _ in part) / rows_per_block)))))
    asked = small_table(spark, [{"pattern": p, "code": c, "begin": b, "x": x} for p, c, b, x in part], "pattern:string,code:string,begin:bigint,x:bigint")
    names = ["pattern", "code"]
    placed = rows.where("size > 0").join(F.broadcast(asked), names)
    placed = placed.select(*names, "x", "size", _place(F.col("key"), F.col("begin")).alias("place")).withColumn("block", F.shiftright("place", KEY_BITS - bits))
    blocks = placed.groupBy(*names, "x", "block").agg(F.sum("size").alias("w"))
    until = F.coalesce(F.sum("w").over(Window.partitionBy(*names).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = blocks.withColumn("before", until).where("before <= x and x < before + w").select(*names, "block", "before")
    found = placed.join(F.broadcast(met), [*names, "block"])
    found = found.groupBy(*names, "x", "block", "before", "place").agg(F.sum("size").alias("size"))
    run = F.col("before") + F.sum("size").over(Window.partitionBy(*names).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    upto = found.withColumn("run", run).groupBy(*names, "x", "block", "before").agg(F.max(F.when(F.col("run") <= F.col("x"), F.struct("place", "run"))).alias("last"))
    base = {}
    for r in upto.collect():
        base[r["pattern"], r["code"]] = (r["last"]["place"], r["x"] - r["last"]["run"]) if r["last"] else ((r["block"] << (KEY_BITS - bits)) - 1, r["x"] - r["before"])
    # The closing document: of those behind the cut, the one whose size is nearest to the rest.
    short = small_table(spark, [{"pattern": p, "code": c, "cut": cut, "rest": rest} for (p, c), (cut, rest) in base.items()], "pattern:string,code:string,cut:bigint,rest:bigint")
    others = placed.join(F.broadcast(short), names).where("place > cut and size < 2 * rest")
    others = others.groupBy(*names, "rest", "place").agg(F.sum("size").alias("size")).where("size < 2 * rest")
    best = others.groupBy(*names).agg(F.min_by(F.struct("place", "size"), F.struct(F.abs(F.col("size") - F.col("rest")), "place")).alias("b"))
    closing = {(r["pattern"], r["code"]): r["b"] for r in best.collect()}
    out = {}
    for ps, (cut, rest) in base.items():
        last = closing.get(ps)
        out[ps] = (cut, last["place"], last["size"] - rest) if last else (cut, None, -rest)
    return out
