"""Small helpers that the text operators share."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import arborlake
from arborlake.operators.numbering import shared_folder

#: The five white-space characters besides the blank that part words.
OTHER_BLANKS = "\t\n\x0b\x0c\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: the lineage is cut,
    and what was computed outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A few driver-made rows as a DataFrame that needs no Python on executors."""
    parsed = F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{ddl}>>"))
    return spark.range(1).select(F.inline(parsed))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` column names, with underscores put before those that ``df`` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bit_map(hashes: DataFrame, bits: int) -> Column:
    """A map of ``bits`` bits (a power of two) of a frame's only column, of hashes, as a literal. The driver
    holds ``bits / 64`` longs, however many hashes there are."""
    place = F.col(hashes.columns[0]).bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    longs = [0] * (bits // 64)
    for r in hashes.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).collect():
        longs[r["word"]] = r["bits"]
    return F.from_json(F.lit(json.dumps(longs)), F.lit("array<bigint>")) if any(longs) else F.lit(None).cast("array<bigint>")


def in_bit_map(map_: Column, h: Column, bits: int) -> Column:
    """Whether a hash may be in the map: true for every one that is, and for some that share its bit."""
    place = h.bitwiseAND(F.lit(bits - 1))
    return F.coalesce(F.bit_get(F.get(map_, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))


#: A key is hot if it has more than one row in so many; there are fewer hot keys than this.
HOT = 1_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``key``, which is unique there, without ``weight``, the number
    of rows that have the key. Hot keys are met by a broadcast of less than HOT rows, the others, none of
    which has more than one row in HOT, by a shuffle, so no key fills a task however frequent it is."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    (mark,) = free_name(table.join(rows.limit(0), key, "left"), "hot")
    is_hot = F.col(weight) * HOT > total
    hot, cold = table.where(is_hot).drop(weight), table.where(~is_hot).drop(weight)
    met = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), key, "left")
    rest = met.where(F.col(mark).isNull()).select(*rows.columns).join(cold, key, "left")
    return met.where(mark).drop(mark).unionByName(rest)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable can't be inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    plain = F.coalesce(text, F.lit(""))
    for c in OTHER_BLANKS:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; texts of ASCII alone take the fast road."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def plain_words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.array_remove(parts, "")


#: Byte table for the same words on UTF-8 bytes: A-Z lowered, every parting byte a blank.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def utf8(text) -> bytes:
    """A text's UTF-8 bytes; null and pandas' missing values are empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def word_bytes(text) -> list[bytes]:
    """The words of :func:`plain_words`, as bytes. bytes.split parts at blanks only here, since
    every other ASCII white space has become one."""
    return utf8(text).translate(WORD_BYTES).split()


def byte_letters() -> dict[int, str]:
    """Byte -> letter of the byte-level alphabet: visible Latin-1 stands for itself, the rest for
    the letters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def batches_by_bytes(texts: list, limit: int) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` characters each, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if isinstance(t, str) else 0
        if size >= limit:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


#: Bounds for what Spark hands to Python at once; texts can be long, so bytes count, not rows.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with Arrow batches small enough for long texts.

    The session's batch limits are lowered where they are larger; a batch holds one row at least.
    Functions of this package travel with the plan, so executors need not have it installed.
    """
    cloudpickle.register_pickle_by_value(arborlake)
    spark = df.sparkSession
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        try:
            if now is None or not 0 < int(now) <= most:
                spark.conf.set(key, str(most))
        except ValueError:
            spark.conf.set(key, str(most))
    return df.mapInArrow(function, schema)


def worker_object(key: tuple, make):
    """An object that a Python worker keeps for all its tasks, such as a tokenizer with its cache.

    It is kept in a module of its own in ``sys.modules``, as functions that travel with a plan get
    new globals for every task. It may only hold what any task would compute alike. The garbage
    collector is kept from walking through it again and again.
    """
    import gc
    import sys
    import types

    kept = sys.modules.setdefault("_arborlake_worker", types.ModuleType("_arborlake_worker")).__dict__
    if kept.get("key") != key:
        kept["key"], kept["object"] = key, make()
        gc.freeze()
        gc.set_threshold(100_000, 20, 50)
    return kept["object"]
