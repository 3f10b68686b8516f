"""Benchmark decontamination: test n-grams as a broadcast hash set, scanned by token windows.

The benchmark's windows are put into two bit maps, one over the hash of a window's first two
words and one over the hash of the whole window. A document's words are scanned in place: only
window starts that pass both maps leave the row, with the window's words, and are verified
against the broadcast windows word by word. The corpus is read once and never joined with
itself; what is shuffled is a row per document and per passing window.

What is broadcast is bounded: blocks of about ``max_windows`` pairs of window and item, however the items
share windows; a larger benchmark is scanned block by block, each against all rows, which are written once
so that a row has the same number in every scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.common import free_name, let, plain_words, written

#: Bits of each map; a power of two, 64 to a long.
MAP_BITS = 1 << 18


def _window_hash(words: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` words from the 0-based place ``at``."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(length)])


def _in_map(bits: Column, h: Column) -> Column:
    place = h.bitwiseAND(F.lit(MAP_BITS - 1))
    word = F.get(bits, F.shiftright(place, 6).cast("int"))
    return F.bit_get(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1


def benchmark_windows(items: DataFrame, n: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, length, window): every ``n`` consecutive words of each item; an item of fewer words,
    but not none, is one window. Null ids count as one item with the empty name."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), plain_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    start = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    words = words.withColumn("length", F.least(F.size("words"), F.lit(n)))
    return words.select("item", "length", F.explode(start).alias("at"), "words").select("item", "length", F.slice("words", F.col("at") + 1, F.col("length")).alias("window")).distinct()


def _bit_map(hashes: list[int]) -> Column:
    """A bit map as an array of longs, folded into a literal."""
    longs = [0] * (MAP_BITS // 64)
    for h in hashes:
        place = h & (MAP_BITS - 1)
        longs[place >> 6] |= 1 << (place & 63)
    signed = [x - (1 << 64) if x >> 63 else x for x in longs]
    return F.from_json(F.lit(str(signed)), F.lit("array<bigint>"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    n: int = 10,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_windows: int = 200_000,
) -> DataFrame:
    """A row per row of ``docs``, with its columns but for the text, and:

    ``n_words``; ``n_hit``, words inside any occurrence of a benchmark window; ``spans``, the merged
    hit intervals ``[first, last]`` in words; ``items``, the sorted ids of the items that occur.

    Null texts and texts without words have no words and no hits. Texts shorter than ``n`` words can
    only be hit by windows of short items. An empty ``docs`` gives no rows, an empty benchmark no
    hits. Equal rows are scanned and reported each. Columns of ``docs`` with the names added here
    are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "spans", "items")
    words, rid, cand, h = free_name(docs, "words", "rid", "cand", "h")
    keep = [c for c in docs.columns if c != text_col]
    windows = benchmark_windows(items, n, id_col=item_id_col, text_col=item_text_col)
    windows = written(windows, "benchmark-windows")
    lengths = {r["length"]: r["m"] for r in windows.groupBy("length").agg(F.count("*").alias("m")).collect()}
    total = sum(lengths.values())
    hashed = None
    for length in sorted(lengths):
        own = windows.where(F.col("length") == length).withColumn("h", _window_hash(F.col("window"), F.lit(0), length))
        hashed = own if hashed is None else hashed.unionByName(own)

    blocks = max(1, -(-total // max_windows))
    docs = docs.withColumn(rid, F.monotonically_increasing_id())
    if blocks > 1:
        docs = written(docs, "contamination-rows")
    split = docs.withColumn(words, plain_words(F.col(text_col)))
    base = split.select(*keep, rid, F.size(words).cast("long").alias("n_words"), words)
    first = [F.first(c).alias(c) for c in [*keep, "n_words"]]  # a row's columns, of any type
    found: DataFrame | None = None
    for b in range(blocks):
        own = None if hashed is None else hashed.where(F.pmod(F.xxhash64("h", "item"), F.lit(blocks)) == b) if blocks > 1 else hashed
        got = own.select("length", "h", F.xxhash64(F.get("window", 0), F.get("window", 1)).alias("pair")).distinct().collect() if own is not None else []
        scans = []
        for length in sorted({r["length"] for r in got}):
            mine = [r for r in got if r["length"] == length]
            scans.append(_scan(length, _bit_map([r["pair"] for r in mine]), _bit_map([r["h"] for r in mine])))
        none = F.lit(None).cast("array<struct<length:int,at:int,h:bigint,window:array<string>>>")
        passing = let(F.col(words), _all_of(scans)) if scans else none
        rows = base.select(*keep, rid, "n_words", passing.alias(cand)).select(*keep, rid, "n_words", F.explode_outer(cand).alias(cand))
        if own is None:
            hits = rows.select(*keep, rid, "n_words", F.lit(None).cast("int").alias("at"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("item"))
        else:
            test = own.select(F.col("h").alias(h), F.col("length").alias("own_length"), F.col("window").alias("own_window"), "item").groupBy(h, "own_length", "own_window").agg(F.collect_set("item").alias("item"))
            same = (F.col(f"{cand}.h") == F.col(h)) & (F.col(f"{cand}.length") == F.col("own_length")) & (F.col(f"{cand}.window") == F.col("own_window"))
            hits = rows.join(F.broadcast(test), same, "left").select(*keep, rid, "n_words", F.when(F.col(h).isNotNull(), F.col(f"{cand}.at")).alias("at"), F.col("own_length").alias("length"), "item")
        per = hits.groupBy(rid).agg(*first, F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "length"))).alias("places"), F.array_distinct(F.flatten(F.collect_set("item"))).alias("items")) if own is not None else hits.select(rid, *keep, "n_words", F.array().cast("array<struct<at:int,length:int>>").alias("places"), F.array().cast("array<string>").alias("items"))
        found = per if found is None else found.unionByName(per)
    if blocks > 1:
        found = found.groupBy(rid).agg(*first, F.flatten(F.collect_list("places")).alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    spans = _merged(F.array_sort("places"))
    out = found.select(*keep, "n_words", spans.alias("spans"), F.array_sort("items").alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return out.select(*keep, "n_words", n_hit.alias("n_hit"), "spans", "items")


def _all_of(scans: list):
    return lambda w: F.concat(*[scan(w) for scan in scans])


def _scan(length: int, pairs: Column, wholes: Column):
    def passing(w: Column) -> Column:
        starts = F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))
        test = lambda i: _in_map(pairs, F.xxhash64(F.get(w, i), F.get(w, i + 1 if length > 1 else F.lit(-1)))) & _in_map(wholes, _window_hash(w, i, length))
        return F.transform(F.filter(starts, test), lambda i: F.struct(F.lit(length).alias("length"), i.alias("at"), _window_hash(w, i, length).alias("h"), F.slice(w, i + 1, length).alias("window")))

    return passing


def _merged(places: Column) -> Column:
    """Sorted windows ``(at, length)`` as disjoint intervals in words."""
    kind = "array<struct<first:bigint,last:bigint>>"

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        first, end = p["at"].cast("long"), (p["at"] + p["length"] - 1).cast("long")
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], end).alias("last"))))
        fresh = F.concat(acc, F.array(F.struct(first.alias("first"), end.alias("last"))))
        return F.when(F.size(acc) == 0, fresh).when(first <= last["last"] + 1, grown).otherwise(fresh)

    return F.aggregate(places, F.array().cast(kind), add)


#: Rows that are hit are broadcast up to this many; more are met by a shuffle.
MOST_BROADCAST = 500_000


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows whose text holds a benchmark window; every other row stays whole."""
    key, size = free_name(docs, "key", "size")
    marked = docs.select("*", F.xxhash64(text_col).alias(key), F.octet_length(text_col).alias(size))
    bad = contamination(marked.select(id_col, text_col, key, size), items, n, text_col=text_col).where("n_hit > 0")
    bad = written(bad.select(F.col(id_col).alias("bad_id"), F.col(key).alias("bad_key"), F.col(size).alias("bad_size")).distinct(), "contaminated")
    if bad.count() <= MOST_BROADCAST:
        bad = F.broadcast(bad)
    same = F.col(id_col).eqNullSafe(F.col("bad_id")) & (F.col(key) == F.col("bad_key")) & (F.col(size) == F.col("bad_size"))
    return marked.join(bad, same, "left_anti").select(*docs.columns)
