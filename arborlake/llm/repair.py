"""Token-id files compressed by a Re-Pair grammar, with random access.

A file part holds the ids of consecutive documents. Rounds replace frequent pairs of neighbouring
symbols by nonterminals: a round counts all pairs that may be frequent, exactly, gives each of the most
frequent ones a rule, and rewrites the sequence from left to right, until no pair is frequent. The part stores the rules, the length that each
rule expands to, the final sequence and the documents' places, so that any range of ids is decoded
from the symbols that cover it alone.

A part is a byte string (see :func:`pack`). Parts are rows of a table in the shared folder, written
and committed by Spark, so a lost executor's parts are written again and nothing is half there.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arborlake.llm.common import byte_letters, map_arrow, worker_object, written

MAGIC = b"ARP1"
#: Defaults: ids of a part, least count of a replaced pair.
PART_IDS, LEAST = 1 << 20, 8
#: A round replaces the pairs that are at least this fraction as frequent as the most frequent one.
NEAR_TOP = 16
CACHE = 800_000
#: Bytes of text that are encoded together.
GATHER = 8 << 20
#: A control character that stands between words which are encoded together.
MARK = "\x01"
#: What the word-end tokenizers do to a text before their merges.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters alone are normalised by str.lower and parted by plain_pieces just so.
PLAIN_TEXT = re.compile("[\t-\r !-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
#: Bytes that no plain text holds: the end of a text, and a word that isn't plain.
END, ODD = b"\x00", b"\x01"
#: Latin-1 bytes of such letters to lower case, and the kinds of lower-cased bytes.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or (0xC0 <= b <= 0xDE and b != 0xD7) else b for b in range(256))
BLANK, LETTER, SIGN, ALONE = range(4)
KINDS = bytes(LETTER if 0x61 <= b <= 0x7A or b >= 0xC0 else ALONE if 0x30 <= b <= 0x39 or b in (0, 1) else SIGN if 0x21 <= b <= 0x7E else BLANK for b in range(256))
#: Sections whose sums are added up at once.
SECTIONS_A_CHUNK = 1_024


def _frequent(keys: np.ndarray, least: int) -> np.ndarray:
    """Which keys may occur ``least`` times: every key that does, and some that share its bin."""
    bits = min(20, max(10, len(keys).bit_length()))
    bins = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    return (np.bincount(bins, minlength=1 << bits) >= least)[bins]


def _grouped(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, where each one's places begin, and the places in order of their key."""
    wide = int(at[-1]).bit_length()
    if int(keys.max()).bit_length() + wide <= 64:
        both = np.sort((keys << np.uint64(wide)) | at.astype(np.uint64))
        keys, at = both >> np.uint64(wide), (both & np.uint64((1 << wide) - 1)).astype(np.int64)
    else:
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], first, at


def compress(ids: np.ndarray, terminals: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): symbol ``terminals + r`` stands for the pair ``rules[r]``.

    Rounds go on until no pair of neighbours occurs ``least`` times. Counts are exact. A round replaces
    the most frequent pairs, from left to right. An occurrence is looked at again only while its pair may
    still be frequent: counts of a pair of old symbols never rise, so what is rare once is rare for good.
    """
    seq = ids.astype(np.uint32)
    open_ = np.ones(len(seq), bool)  # the pair that begins here may be frequent
    open_[-1:] = False
    rules: list[np.ndarray] = []
    made = 0
    while True:
        at = np.flatnonzero(open_)
        wide = np.uint64((terminals + made).bit_length())
        keys = (seq[at].astype(np.uint64) << wide) | seq[at + 1]
        may = _frequent(keys, least) if len(at) else np.zeros(0, bool)
        open_[at[~may]] = False
        if not may.any():
            break
        pairs, first, at = _grouped(keys[may], at[may])
        counts = np.diff(first, append=len(at))
        chosen = counts >= max(least, int(counts.max()) // NEAR_TOP)
        if not chosen.any():
            break
        pairs = pairs[chosen]
        # Places in order, each with its rule: 32 bits hold either, as a part's documents have fewer ids.
        which = np.repeat(np.arange(len(pairs), dtype=np.uint64), counts[chosen])
        both = np.sort((at[np.repeat(chosen, counts)].astype(np.uint64) << np.uint64(32)) | which)
        at, place = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # From left to right: of pairs that overlap, every other one.
        run = np.concatenate([[True], np.diff(at) > 1])
        begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        first = (np.arange(len(at)) - begin) % 2 == 0
        at, place = at[first], place[first]
        there = np.bincount(place, minlength=len(pairs)) > 0
        used, rule = np.flatnonzero(there), (np.cumsum(there) - 1)[place]
        seq[at] = (terminals + made + rule).astype(np.uint32)
        open_[at] = open_[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        seq, open_ = seq[keep], open_[keep]
        open_[-1] = False
        rules.append(np.stack([pairs[used] >> wide, pairs[used] & np.uint64((1 << int(wide)) - 1)], 1).astype(np.uint32))
        made += len(used)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for; a rule uses earlier symbols only."""
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append((1 if a < terminals else lengths[a - terminals]) + (1 if b < terminals else lengths[b - terminals]))
    return np.array(lengths, np.int64)


def pack(ids: np.ndarray, ends: np.ndarray, terminals: int, **how: int) -> bytes:
    """A part: header, documents' ends, rules, expansion lengths, sequence (little-endian; the symbols' low
    16 bits, then, where there are more symbols, the rest of each in one byte or two)."""
    seq, rules = compress(ids, terminals, **how)
    top = terminals + len(rules)
    wide = 2 if top <= 1 << 16 else 3 if top <= 1 << 24 else 4
    head = struct.pack("<4sBxxxIQQQ", MAGIC, wide, terminals, len(rules), len(seq), len(ends))
    low, high = (seq & 0xFFFF).astype("<u2").tobytes(), (seq >> 16).astype("<u1" if wide == 3 else "<u2").tobytes()
    return b"".join([head, ends.astype("<u8").tobytes(), rules.astype("<u4").tobytes(), expansion_lengths(rules, terminals).astype("<u4").tobytes(), low, high if wide > 2 else b""])


class Part:
    """A packed part, decoded on demand."""

    def __init__(self, blob: bytes) -> None:
        magic, wide, self.terminals, n_rules, n_seq, n_docs = struct.unpack_from("<4sBxxxIQQQ", blob)
        if magic != MAGIC:
            raise ValueError("not a part of ids")
        at = struct.calcsize("<4sBxxxIQQQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(blob, kind, n, at)
            at += got.nbytes
            return got

        self.ends = take("<u8", n_docs).astype(np.int64)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        self.seq = take("<u2", n_seq).astype(np.uint32)
        if wide > 2:
            self.seq |= take("<u1" if wide == 3 else "<u2", n_seq).astype(np.uint32) << 16
        if at != len(blob):
            raise ValueError("the part has another length than its header says")
        self._starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._flat = self._expanded()
        sym = self.seq.astype(np.int64)
        self._reach = np.cumsum(np.where(sym < self.terminals, 1, self.lengths[np.maximum(sym - self.terminals, 0)] if n_rules else 1))

    def _expanded(self) -> np.ndarray:
        """What the rules stand for, one after the other; rules of one height are expanded together."""
        flat = np.zeros(int(self._starts[-1]), np.uint32)
        height: list[int] = []
        for a, b in self.rules.tolist():
            height.append(1 + max(height[a - self.terminals] if a >= self.terminals else 0, height[b - self.terminals] if b >= self.terminals else 0))
        height = np.array(height, np.int64)
        for h in range(1, int(height.max(initial=0)) + 1):
            own = np.flatnonzero(height == h)
            to = self._starts[own]
            for side in (0, 1):
                sym = self.rules[own, side].astype(np.int64)
                plain = sym < self.terminals
                rule = np.maximum(sym - self.terminals, 0)
                size = np.where(plain, 1, self.lengths[rule])
                flat[to[plain]] = sym[plain]
                n = size[~plain]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                flat[np.repeat(to[~plain], n) + step] = flat[np.repeat(self._starts[rule[~plain]], n) + step]
                to = to + size
        return flat

    def __len__(self) -> int:
        return int(self._reach[-1]) if len(self._reach) else 0

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end``; only the symbols that cover them are expanded."""
        if end <= begin:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self._reach, [begin, end - 1], side="right")
        sym = self.seq[a : b + 1].astype(np.int64)
        size = np.diff(self._reach[a : b + 1], prepend=self._reach[a - 1] if a else 0)
        rule = np.maximum(sym - self.terminals, 0)
        source = self._starts[rule] if len(self.rules) else rule
        stop = np.cumsum(size)
        place = np.arange(int(stop[-1])) - np.repeat(stop - size, size)
        out = np.repeat(sym, size)
        ruled = np.repeat(sym >= self.terminals, size)
        out[ruled] = self._flat[(np.repeat(source, size) + place)[ruled]]
        skip = begin - (int(self._reach[a - 1]) if a else 0)
        return out[skip : skip + end - begin].astype(np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def plain_pieces(text: bytes) -> pa.LargeBinaryArray:
    """The lower-cased PIECES of plain texts in Latin-1, END behind each; every END and ODD is a piece too."""
    text = text.translate(LOWER)
    low, kind = np.frombuffer(text, np.uint8), np.frombuffer(text.translate(KINDS), np.uint8)
    solid = kind != BLANK
    begins = solid & ((np.diff(kind, prepend=np.uint8(BLANK)) != 0) | (kind == ALONE))
    # 's, 't, 'm, 'd, 're, 've, 'll where a piece begins; what follows is a piece of its own.
    at = np.flatnonzero(low == ord("'"))
    at = at[begins[at]]
    one, two = low[at + 1], low[np.minimum(at + 2, len(low) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    begins[at[short | long] + 1] = False
    after = np.concatenate([at[short] + 2, at[long] + 3])
    begins[after[kind[after] == LETTER]] = True
    low, starts = low[solid], np.flatnonzero(begins[solid])
    offsets = np.append(starts, len(low)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)])


class Runs:
    """Runs of ids by key, one after the other in a flat array."""

    def __init__(self) -> None:
        self.place: dict = {}
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def add(self, keys: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        n, m = len(self.place), len(keys)
        if n + m > len(self.starts):
            more = max(n + m, 2 * len(self.starts))
            self.starts, self.sizes = (np.concatenate([x, np.zeros(more - len(x), np.int64)]) for x in (self.starts, self.sizes))
        if self.used + len(ids) > len(self.flat):
            more = max(self.used + len(ids), 2 * len(self.flat))
            self.flat = np.concatenate([self.flat, np.zeros(more - len(self.flat), np.uint32)])
        self.sizes[n : n + m] = sizes
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(keys, range(n, n + m), strict=True))

    def places(self, keys: list) -> np.ndarray:
        """Where each key's run is kept; -1 if it isn't."""
        return np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs at these places, joined, and their sizes."""
        sizes = self.sizes[places]
        ahead = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[places] - ahead, sizes)
        at += np.arange(len(at))
        return self.flat[at], sizes


class Encoder:
    """Texts to ids with a ``tokenizers`` file; pieces and words are encoded once.

    If the tokenizer's steps are the known ones (checked), the pieces of a text of ASCII and Latin-1 letters,
    digits and marks are found here, and the library's model gives a piece's ids. Else, if pre-tokens
    never span white space and drop it (checked), a text's ids are those of its words between blanks, one
    after the other; words that are not of such characters are encoded whole by the library. If they may
    span it, so are texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        split, norm = steps[0], spec["normalizer"] or {}
        known = [n["type"] for n in norm.get("normalizers", [norm] if norm else [])]
        pattern = split.get("pattern", {}).get("Regex", "")
        self.by_word = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and "\\s" in pattern and set(known) <= set(NORMALIZERS)
        byte_level = [x.get("type") for x in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        self.by_piece = bool(self.by_word and pattern == PIECES and known == NORMALIZERS and byte_level and spec["model"].get("dropout") is None)
        self.terminals = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.holds_added = re.compile("|".join(added) if added else "(?!)").search
        self.letters = byte_letters()
        self.mark_id = (self.tokenizer.encode(MARK, add_special_tokens=False).ids or [-1])[0]
        self.runs = Runs()

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end_id`` behind, joined, and the number of each text's ids."""
        if len(self.runs.place) > CACHE:
            self.runs = Runs()
        if END not in self.runs.place:
            self.runs.add([END, ODD], np.array([1, 0]), np.array([end_id], np.uint32))
        odd: list[str] = []
        plain = END.join([*(self._plain(t, odd) for t in texts), b""])
        # Equal pieces of a batch are found in a compact table, so that the large one is asked once a piece.
        table = plain_pieces(plain).dictionary_encode()
        own, indices = table.dictionary.to_numpy(zero_copy_only=False).tolist(), table.indices.to_numpy()
        ends, others = (indices == own.index(mark) if mark in own else np.zeros(len(indices), bool) for mark in (END, ODD))
        places = self._places(own)[indices]
        if odd:
            words = pa.array(odd, pa.large_string()).dictionary_encode()
            places[others] = self._places(words.dictionary.to_pylist())[words.indices.to_numpy()]
        ids, sizes = self.runs.take(places)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.flatnonzero(ends) + 1])]
        return ids, np.diff(upto)

    def _places(self, keys: list[bytes] | list[str]) -> np.ndarray:
        """Where the runs of distinct keys, plain pieces or odd words, are kept; those that aren't known yet are learnt."""
        places = self.runs.places(keys)
        lacking = np.flatnonzero(places < 0).tolist()
        if lacking:
            fresh = [keys[i] for i in lacking]
            self._learn(fresh)
            places[lacking] = self.runs.places(fresh)
        return places

    def _plain(self, text: str, odd: list[str]) -> bytes:
        """The text in Latin-1 if it is plain, else its plain words, with ODD in place of others. These go to ``odd``, a word
        behind a blank, the text behind two."""
        if self.by_piece and PLAIN_TEXT(text) and not self.holds_added(text):
            return text.encode("latin-1")
        # str.split parts at four control characters that the tokenizers' \s leaves alone.
        if not self.by_word or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            odd.append(f"  {text}")
            return ODD
        words = []
        for w in text.split():
            if self.by_piece and PLAIN_TEXT(w) and not self.holds_added(w):
                words.append(w.encode("latin-1"))
            else:
                odd.append(f" {w}")
                words.append(ODD)
        return b" ".join(words)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: list[bytes] | list[str]) -> None:
        tokenize, letters = self.model.tokenize, self.letters
        plain = [k for k in keys if isinstance(k, bytes)]
        ids: list[int] = []
        ends = []
        for p in plain:
            ids += [t.id for t in tokenize(p.decode() if p.isascii() else "".join([letters[b] for b in p.decode("latin-1").encode()]))]
            ends.append(len(ids))
        self.runs.add(plain, np.diff(np.array(ends, np.int64), prepend=0), np.array(ids, np.uint32))
        odd = [k for k in keys if isinstance(k, str) and k[:2] != "  " and MARK not in k]
        for i in range(0, len(odd), 4096):
            self._learn_odd(odd[i : i + 4096])
        self._learn_whole([k for k in keys if isinstance(k, str) and (k[:2] == "  " or MARK in k)])

    def _learn_odd(self, keys: list[str]) -> None:
        """Words of any letters, encoded as one text with a mark between them that none of them holds."""
        ids = self._whole(f" {MARK}".join([*keys, ""]))
        ends = np.flatnonzero(ids == self.mark_id)
        if len(ends) == len(keys):
            self.runs.add(keys, np.diff(ends, prepend=-1) - 1, np.delete(ids, ends))
        else:  # the mark is not an id of its own here
            self._learn_whole(keys)

    def _learn_whole(self, keys: list[str]) -> None:
        alone = [self._whole(k[2:] if k[:2] == "  " else k[1:]) for k in keys]
        if keys:
            self.runs.add(keys, np.array([len(x) for x in alone]), np.concatenate(alone))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Small batches joined to some of about GATHER bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= GATHER:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    *,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_ids: int = PART_IDS,
    partition_bytes: int = 24 << 20,
) -> DataFrame:
    """The table of parts, written: (section, part, doc_ids, n_ids, blob), in ascending order of
    documents by (section, part, place).

    Sections are ranges of the document id and, where ids are equal, of the text's hash. A part ends at
    the first document that brings it to ``part_ids`` ids; a document is never split. Null and empty texts
    have the end id alone; null ids come first; documents of one id stand together, ordered by the hash
    of the text. Repeated rows lie in one section, cut into as many parts as they need. Ids may be of any
    type that Spark orders. Other columns don't count. An empty table has no parts.
    """
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    sections = max(8, -(-total // partition_bytes))
    # Equal ids may be many: the text's hash parts them, and keeps the order by id.
    ordered = docs.select(id_col, text_col, F.xxhash64(text_col).alias("by")).repartitionByRange(sections, F.asc_nulls_first(id_col), "by").sortWithinPartitions(F.asc_nulls_first(id_col), "by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_object(("encoder", tokenizer), lambda: Encoder(tokenizer))
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        part = section = total = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = {"section": [section], "part": [part], "doc_ids": [list(names)], "n_ids": [len(ids)], "blob": [pack(ids, np.cumsum(np.concatenate(sizes)), max(encoder.terminals, end_id + 1))]}
            return pa.RecordBatch.from_pydict(row, schema=out_schema)

        for batch in _gathered(batches):
            section = batch.column(2)[0].as_py()
            own = batch.column(0).to_pylist()
            ids, counts = encoder.encode([t or "" for t in batch.column(1).to_pylist()], end_id)
            ends = np.cumsum(counts)
            begin = 0  # documents of the batch that are in parts already
            while begin < len(own):
                done = int(ends[begin - 1]) if begin else 0
                upto = min(int(np.searchsorted(ends, done + part_ids - total)) + 1, len(own))
                names += own[begin:upto]
                held.append(ids[done : ends[upto - 1]])
                sizes.append(counts[begin:upto])
                total += int(ends[upto - 1]) - done
                begin = upto
                if total >= part_ids:
                    yield flush()
                    names, held, sizes, total, part = [], [], [], 0, part + 1
        if held:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    out_schema = pa.schema([("section", pa.int32()), ("part", pa.int32()), ("doc_ids", pa.list_(to_arrow_type(docs.schema[id_col].dataType))), ("n_ids", pa.int64()), ("blob", pa.binary())])
    tagged = ordered.select(id_col, text_col, F.spark_partition_id().alias("section"))
    return written(map_arrow(tagged, run, f"section int, part int, doc_ids array<{kind}>, n_ids bigint, blob binary"), "token-ids")


def read_ids(parts: DataFrame, *, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) per document, decoded from the written parts.

    Parts are decoded where they are read; only narrow rows are joined with the places at which parts
    start, which are added up section by section inside chunks of sections, and over chunks.
    """
    chunk = F.floor(F.col("section") / SECTIONS_A_CHUNK)
    sizes = parts.select("section", "part", "n_ids", chunk.alias("chunk"))
    ahead = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    chunks = sizes.groupBy("chunk").agg(F.sum("n_ids").alias("n_ids")).withColumn("base", ahead(Window.orderBy("chunk"))).drop("n_ids")
    heads = sizes.withColumn("inside", ahead(Window.partitionBy("chunk").orderBy("section", "part"))).join(F.broadcast(chunks), "chunk")
    heads = heads.select("section", "part", (F.col("base") + F.col("inside")).alias("head"))
    id_kind = parts.schema["doc_ids"].dataType.elementType
    out_kind = to_arrow_type(id_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for section, number, names, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                part = Part(blob)
                ids = part.ids(0, len(part)).astype("<u4")
                begins = np.concatenate([[0], part.ends[:-1]])
                raw = memoryview(ids.tobytes())
                cuts = list(zip(begins.tolist(), part.ends.tolist(), strict=True))
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in cuts]
                n = len(names)
                columns = [pa.array(names, out_kind), pa.array([section] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(begins), pa.array(part.ends - begins), pa.array(crcs, pa.int64())]
                heads = ["own_id", "section", "part", "begin", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in cuts], pa.list_(pa.int64())))
                    heads.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=heads)

    schema = f"own_id {id_kind.simpleString()}, section int, part int, begin bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    decoded = map_arrow(parts.select("section", "part", "doc_ids", "blob"), run, schema)
    out = decoded.join(heads, ["section", "part"])
    return out.select(F.col("own_id").alias(id_col), (F.col("head") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
