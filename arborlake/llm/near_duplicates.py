"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text is the set of its five-word shingles, each of weight 1 however often it occurs, as links are
verified on plain sets: with weights by count, pairs that repeat shingles would meet too seldom. Each element
arrives at the times of a Poisson process whose rate is its weight, each arrival at a random slot; a
slot keeps the element that arrived first. An element is dropped as soon as its next arrival is later
than every slot's first. Two texts agree in a slot with probability equal to their probability Jaccard
similarity (Ertl 2020), with equal weights the plain Jaccard similarity. Slots are cut into bands; texts
that agree in a band meet in a bucket: with 50 bands of 7 slots, two texts of similarity 0.8 do with
probability 0.99999.

Texts of equal shingle sets are one node. In three rounds every bucket names one hub of its unsettled
nodes, and all its nodes, settled or not, are compared with the hub, exactly, on their shingle sets.
Nodes that a hub accepts are settled. Then the accepted links are followed, and in every bucket all pairs
of nodes that are not joined yet, and whose bit maps allow it, are compared too. So the classes are those of
all pairs that meet in a bucket, while nodes that are joined already, such as a large group of copies, are
never paired. Sets are held as 32-bit hashes.
Classes are the connected components of the accepted links.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import HOT, batches_by_bytes, free_name, join_hot, map_arrow, shared_folder, word_bytes, written

SHINGLE, BANDS, BAND_SLOTS = 5, 50, 7
SLOTS = BANDS * BAND_SLOTS
CACHE = 250_000
#: Bits of the map of nodes that take part in a round; fixed, so that it may be broadcast.
MAP_BITS = 1 << 21
#: Bits of the map of rows that go, and of sets that several rows have; fixed, so that it may be broadcast.
ROW_MAP_BITS = 1 << 23
#: Characters of text that are signed at once; a text is signed whole, however long.
SIGN_BYTES = 1 << 20
#: Bits of a set's map, a multiple of 64.
SET_MAP_BITS = 1_024
#: Sets up to this size in all may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Pairs of one node that meet one copy of its set.
SALT = 4_096
#: Nodes of a bucket that one task pairs at a time with those outside of the bucket's main component.
BLOCK = 2_048


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted distinct shingle hashes and their counts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _word(self, w: bytes) -> int:
        if len(self.known) > CACHE:
            self.known.clear()
        h = self.known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h

    def shingles(self, text) -> tuple[np.ndarray, np.ndarray]:
        words = word_bytes(text)
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        get = self.known.get
        ids = list(map(get, words))
        if None in ids:
            ids = [self._word(w) if h is None else h for w, h in zip(words, ids, strict=True)]
        h = np.array(ids, np.uint64)
        width = min(SHINGLE, len(h))
        n = len(h) - width + 1
        s = np.full(n, width, np.uint64)
        for j in range(width):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
        return np.unique(s, return_counts=True)


def prob_min_hash(elements: list[np.ndarray], weights: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents x slots) of weighted sets; an empty set has zeros."""
    docs = len(elements)
    first = np.full(docs * slots, np.inf)
    sig = np.zeros(docs * slots, np.uint64)
    sizes = np.array([len(e) for e in elements], np.int64)
    if not sizes.sum():
        return sig.reshape(docs, slots)
    e = np.concatenate(elements)
    w = np.concatenate(weights).astype(np.float64)
    d = np.repeat(np.arange(docs), sizes)
    t = np.zeros(len(e))
    made = np.zeros(len(e), np.int64)  # arrivals so far
    while len(e):
        active = np.bincount(d, minlength=docs)
        many = np.maximum(1, -(-2 * slots // np.maximum(active, 1)))[d]
        ends = np.cumsum(many)
        of = np.repeat(np.arange(len(e)), many)
        nth = np.arange(ends[-1]) - np.repeat(ends - many, many) + made[of]
        bits = _mix(e[of] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        u = ((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
        gap = np.cumsum(-np.log(u) / w[of])
        time = gap - np.repeat(np.concatenate([[0.0], gap[ends[:-1] - 1]]), many) + t[of]
        slot = d[of] * slots + (_mix(bits ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        sig[slot[won]] = e[of[won]]
        t = time[ends - 1]
        made += many
        latest = np.full(docs, -1.0)
        some = np.flatnonzero(active)
        latest[some] = first.reshape(docs, slots)[some].max(1)
        go = t < latest[d]
        e, w, d, t, made = e[go], w[go], d[go], t[go], made[go]
    return sig.reshape(docs, slots)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    by_band = signatures.reshape(len(signatures), BANDS, BAND_SLOTS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for j in range(BAND_SLOTS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + by_band[:, :, j])
    return key.view(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node row id, id, text hash, shingle count, set hash, band keys, shingles as int32, bit map), written."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for part in batches_by_bytes(texts, SIGN_BYTES):
                sets = [shingler.shingles(t)[0] for t in texts[part]]
                keys = band_keys(prob_min_hash(sets, [np.ones(len(e)) for e in sets]))
                digests = [hashlib.blake2b(e.tobytes(), digest_size=16).digest() if len(e) else None for e in sets]
                short = [np.unique((e >> np.uint64(32)).astype(np.uint32)).view(np.int32) for e in sets]
                bands = [k if len(e) else k[:0] for k, e in zip(keys, sets, strict=True)]
                columns = [
                    *(c.slice(part.start, part.stop - part.start) for c in batch.columns[:3]),
                    pa.array([len(e) for e in short], pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists(bands, pa.int64()),
                    _lists(short, pa.int32()),
                    _lists([set_map(e) for e in short], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "id", "text_hash", "n", "digest", "bands", "shingles", "map"])

    return written(map_arrow(rows, run, f"rid bigint, id {kind}, text_hash bigint, n bigint, digest binary, bands array<bigint>, shingles array<int>, map array<bigint>"), "near-signatures")


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], kind))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the least node of its component.

    Contraction: every component takes the least neighbouring component as its parent, parents are
    followed to their roots, and links inside a component are dropped, until none is left. Each step
    is written to the shared folder.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    open_links = written(links.select("a", "b").where("a <> b").distinct(), "component-links")
    while open_links.take(1):
        both = open_links.union(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent")), "component-parents")
        while True:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            twice = parents.join(up, "parent").select("node", F.col("above").alias("parent"))
            top = twice.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
            parents = written(top, "component-parents")
            if not parents.where("moved").take(1):
                break
        map_ = parents.select(F.col("node").alias("root"), F.col("parent").alias("top"))
        roots = written(roots.join(map_, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "component-roots")
        a = map_.select(F.col("root").alias("a"), F.col("top").alias("x"))
        b = map_.select(F.col("root").alias("b"), F.col("top").alias("y"))
        open_links = written(open_links.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "component-links")
    return roots


def _taking_part(rows: DataFrame, rids: DataFrame) -> DataFrame:
    """``rows`` that may have their ``rid`` in ``rids``: a bit map of fixed size is broadcast, so that
    the others needn't be shuffled. Where bits are shared, more rows stay; none is lost."""
    word = F.shiftright(F.xxhash64("rid"), 6).bitwiseAND(F.lit(MAP_BITS // 64 - 1)).cast("int")
    bit = F.xxhash64("rid").bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = rids.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(bits), "word").where(F.bit_get("bits", bit) == 1).drop("word", "bits")


def _nodes(some: DataFrame, groups: DataFrame) -> DataFrame:
    """(rid, n, bands) of the first row of each shingle set.

    A map of fixed size, of sets that several rows have, is broadcast: a row whose set isn't in it is the only one
    and stays where it is. Only the others, bands and all, are shuffled to see which of them are first.
    """
    place = F.xxhash64("digest").bitwiseAND(F.lit(ROW_MAP_BITS - 1))
    bit = place.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = groups.where("rows > 1").groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    may_repeat = F.coalesce(F.bit_get("bits", bit) == 1, F.lit(False))
    rows, firsts = (df.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(bits), "word", "left") for df in (some.select("rid", "n", "bands", "digest"), groups.select("node", "digest")))
    firsts = firsts.where(may_repeat).select(F.col("node").alias("rid"))
    only = rows.where(~may_repeat).select("rid", "n", "bands")
    return only.unionByName(rows.where(may_repeat).select("rid", "n", "bands").join(firsts, "rid", "left_semi"))


def _may_reach(n: Column, m: Column, map_n: Column, map_m: Column, threshold: tuple[int, int]) -> Column:
    """Whether sets of ``n`` and ``m`` elements may be as similar as the threshold by their bit maps: every bit
    in which these differ is due to an element that one set lacks, so if they differ in h bits, at most
    (n + m - h) / 2 elements are common."""
    num, den = threshold
    bits = [F.bit_count(F.get(map_n, i).bitwiseXOR(F.get(map_m, i))) for i in range(SET_MAP_BITS // 64)]
    return (n + m - sum(bits[1:], bits[0])) * (num + den) >= (n + m) * (2 * num)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of (a, b), those whose sets' Jaccard similarity is at least the threshold (a fraction).

    Bit maps go first, so that only sets of pairs that may reach it are fetched. The sets of ``b``, which are few
    where they are hubs or what is left over, are broadcast if they come to BROADCAST_BYTES at most, by their
    measured size; else they are met by a shuffle.
    """
    maps = [sets.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("map").alias(f"map_{x}")) for x in "ab"]
    may = _may_reach(F.col("n_a"), F.col("n_b"), F.col("map_a"), F.col("map_b"), threshold)
    pairs = written(pairs.join(maps[0], "a").join(maps[1], "b").where(may).select("a", "b"), "near-candidates")
    num, den = threshold
    side = {x: _taking_part(sets.drop("map"), pairs.select(F.col(x).alias("rid"))).select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab"}
    met = pairs.join(side["a"].hint("merge"), "a")
    if 4 * (side["b"].agg(F.sum("n_b")).first()[0] or 0) <= BROADCAST_BYTES:
        both = met.join(F.broadcast(side["b"]), "b")
    else:
        both = _dealt(met, side["b"], pairs)
    both = both.withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    return both.where(F.col("common") * den >= num * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _dealt(met: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """``met`` joined with the sets of ``b``. A node of very many pairs, such as the hub of a large group, has its
    pairs dealt over several tasks, each with a copy of its set: there are fewer such nodes than HOT, and a
    copy for every SALT pairs."""
    counts = pairs.groupBy("b").agg(F.count("*").alias("m")).where(F.col("m") > SALT)
    hot = counts.where(F.col("m") * HOT > pairs.count()).select("b", F.ceil(F.col("m") / SALT).cast("int").alias("salts"))
    hot = F.broadcast(written(hot, "near-hot"))
    b = b.join(hot, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    dealt = met.join(hot, "b", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    return dealt.join(b.hint("merge"), ["b", "salt"])


def _links(signed: DataFrame, nodes: DataFrame, threshold: tuple[int, int], rounds: int = 3) -> DataFrame:
    """Verified links (a, b) between nodes (rid, n, bands). Their components are those of all pairs of
    nodes that share a bucket and reach the threshold."""
    entries = nodes.select("rid", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = written(entries.join(shared, "key"), "near-buckets")
    sets = written(_taking_part(signed.select("rid", "n", "shingles", "map"), met.select("rid")), "near-sets")
    rank = met.groupBy("rid").agg(F.sum("m").alias("rank"))
    waiting = written(met.select("rid", "n", "key").join(rank, "rid").withColumn("open", F.lit(True)), "near-buckets")

    num, den = threshold
    folder = f"{shared_folder(signed.sparkSession)}/near-links-{uuid.uuid4().hex}"
    for turn in range(rounds):
        # Later hubs differ from bucket to bucket, so that a node meets many of them.
        order = F.struct("rank", -F.col("rid")) if not turn else F.struct(F.xxhash64("key", "rid"), -F.col("rid"))
        hub = F.max_by(F.struct("rid", "n"), F.when(F.col("open"), order))
        hubs = waiting.groupBy("key").agg(hub.alias("hub")).select("key", F.col("hub.rid").alias("b"), F.col("hub.n").alias("n_b"))
        others = waiting.join(hubs, "key").where("rid <> b")
        fits = (F.col("n") * den >= num * F.col("n_b")) & (F.col("n_b") * den >= num * F.col("n"))
        pairs = others.where(fits).select(F.col("rid").alias("a"), "b").distinct()
        good = _verified(pairs, sets, threshold)
        good.write.parquet(f"{folder}/turn={turn}")
        good = good.sparkSession.read.schema(good.schema).parquet(f"{folder}/turn={turn}")
        if turn + 1 == rounds:
            break
        near = good.select(F.col("a").alias("rid"), "b", F.lit(True).alias("ok"))
        left = others.join(near, ["rid", "b"], "left").withColumn("open", F.col("open") & F.col("ok").isNull()).select("rid", "n", "key", "rank", "open")
        still = left.groupBy("key").agg(F.max("open").alias("some"), F.count("*").alias("m")).where("some and m > 1")
        waiting = written(left.join(still.select("key"), "key"), "near-buckets")
        if not waiting.take(1):
            break

    read = signed.sparkSession.read.schema("a bigint, b bigint, turn int")
    once = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    hub_links = read.parquet(folder).select(*once).distinct()
    _verified(_apart(met, hub_links, sets, threshold), sets, threshold).write.parquet(f"{folder}/turn={rounds}")
    return written(read.parquet(folder).select(*once).distinct(), "near-links")


def _apart(met: DataFrame, links: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket, may reach the threshold and that ``links`` do not join
    yet, however indirectly. A bucket's largest component isn't paired with itself, so that only what lies
    outside of it meets all nodes, in blocks.

    Nodes are met with their bit maps, and a pair is made only if these allow it. No pair that reaches the
    threshold is lost.
    """
    num, den = threshold
    roots = connected_components(links).select(F.col("node").alias("rid"), "root")
    entries = met.select("rid", "n", "key", "m").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    parts = entries.groupBy("key", "root").agg(F.count("*").alias("k"))
    parts = parts.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    entries = written(entries.join(parts, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m"), "near-apart")
    entries = entries.join(_taking_part(sets.select("rid", "map"), entries.select("rid")), "rid")

    minor = entries.where("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    minor = minor.select("key", "block", F.col("rid").alias("x"), F.col("n").alias("n_x"), F.col("root").alias("root_x"), F.col("map").alias("map_x"))
    every = entries.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    fits = (F.col("n") * den >= num * F.col("n_x")) & (F.col("n_x") * den >= num * F.col("n"))
    enough = _may_reach(F.col("n"), F.col("n_x"), F.col("map"), F.col("map_x"), threshold)
    once = (F.col("root") == F.col("main")) | (F.col("x") < F.col("rid"))
    same = (minor["key"] == every["key"]) & (minor["block"] == every["block"])
    pairs = minor.join(every, same & (F.col("root") != F.col("root_x")) & once & fits & enough)
    return pairs.select(F.col("rid").alias("a"), F.col("x").alias("b")).distinct()


def set_map(elements: np.ndarray) -> np.ndarray:
    """A bit map of a set of hashes, as longs."""
    bits = np.zeros(SET_MAP_BITS, np.uint8)
    bits[elements.astype(np.int64) & (SET_MAP_BITS - 1)] = 1
    return np.packbits(bits).view(np.int64)


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """A row per row of ``docs``: the id, ``text_hash``, ``class_id`` (the least id of the class), ``class_size``,
    ``n_links`` (verified links of the row's shingle set to other sets) and ``stays`` (true for one row of
    each class, that of the least id).

    Texts are linked from a Jaccard similarity of ``threshold`` on, a fraction, over five-word shingles of
    lower-cased words; a text of one to four words is one shingle. Equal shingle sets are one class.
    Null, empty and word-less texts are alone in a class each. Null ids come first as the least id.
    Repeated rows are rows of their own in one class. An empty table gives no rows. Whole texts count.
    """
    signed = _signed(docs, id_col, text_col)
    some = signed.where("n > 0")
    groups = written(some.groupBy("digest").agg(F.min("rid").alias("node"), F.min(F.struct("id", "rid")).alias("least"), F.count("*").alias("rows")), "near-groups")
    links = _links(signed, _nodes(some, groups), threshold)

    # Classes of sets, not of rows: a row learns of its class by its set alone.
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    sets = groups.join(connected_components(links), "node", "left").join(degree, "node", "left")
    sets = written(sets.withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))), "near-sets-of-class")
    classes = sets.groupBy("root").agg(F.min("least").alias("first"), F.sum("rows").alias("class_size"), F.count("*").alias("n_sets"))
    sets = join_hot(sets, written(classes, "near-classes"), "root", "n_sets")
    info = written(sets.select("digest", "rows", "n_links", "class_size", "first"), "near-info")
    out = join_hot(some.select("rid", "id", "text_hash", "digest"), info, "digest", "rows").select("rid", "id", "text_hash", "n_links", "class_size", "first")
    zero, one = (F.lit(x).cast("long") for x in (0, 1))
    alone = signed.where("n = 0").select("rid", "id", "text_hash", zero.alias("n_links"), one.alias("class_size"), F.struct("id", "rid").alias("first"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("first.id").alias("class_id"), "class_size", "n_links", (F.col("rid") == F.col("first.rid")).alias("stays"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class; columns and texts are as they were.

    Rows are told by id and text. A map of fixed size, of those that go, is broadcast: a row that isn't in
    it stays where it is, and only the others, texts and all, are shuffled to see which of them stay.
    """
    key, word, bits = free_name(docs, "key", "word", "bits")
    classes = written(near_duplicate_classes(docs, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("own_id"), F.col("text_hash").alias("own_hash"), "stays"), "near-verdicts")
    place = lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(ROW_MAP_BITS - 1))
    gone = classes.where(~F.col("stays")).select(place(F.col("own_id"), F.col("own_hash")).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    map_ = gone.groupBy(F.shiftright("p", 6).alias(word)).agg(F.bit_or(one).alias(bits))

    marked = docs.withColumn(key, F.xxhash64(text_col))
    at = place(F.col(id_col), F.col(key))
    marked = marked.withColumn(word, F.shiftright(at, 6)).join(F.broadcast(map_), word, "left")
    may_go = F.coalesce(F.bit_get(bits, at.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    keep = classes.where("stays").drop("stays")
    same = marked[id_col].eqNullSafe(keep["own_id"]) & (marked[key] == keep["own_hash"])
    rest = marked.where(may_go).join(keep, same, "left_semi").dropDuplicates([id_col, key])
    return marked.where(~may_go).select(*docs.columns).unionByName(rest.select(*docs.columns))
