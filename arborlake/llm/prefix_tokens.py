"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-pair encoding has the property that the encoding of a string's prefix ends in exactly one
token t for which the encoding of the rest ends in a token that may stand before t ("may stand":
encoding the two together gives the two again). So count(i) = count(i - len(t)) + 1, and one pass
gives the exact count of every prefix: where a text must be cut to fit a budget, or how many tokens
a part costs, is then a look-up, and nothing is encoded again.

Texts are parted where the tokenizer's own pattern always parts: between a non-blank and a blank.
A part's counts don't depend on its neighbours, so frequent parts are computed once per worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from arborlake.llm.common import byte_letters, map_arrow, worker_object

#: Fixed value: the byte-level tokenizers' pattern for pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each kind that a worker keeps; then it starts anew.
CACHE = 1_000_000
#: Steps are stored in one byte each, or in eight where one of the text's is beyond this.
MOST = 127


class Wide(Exception):
    """A step that doesn't fit the narrow form."""


class PrefixCounter:
    """Token counts at every prefix for a byte-level BPE in the ``tokenizers`` JSON format."""

    def __init__(self, path: str, kind: str = "i1") -> None:
        self.path, self.kind, self.wide = path, np.dtype(kind), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE is supported")
        self.rank = {tuple(m): i for i, m in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.trie: dict = {}
        self.tokens: list[str] = []
        for token in spec["model"]["vocab"]:
            if token in self.special:
                continue
            node = self.trie
            for c in reversed(token):
                node = node.setdefault(c, {})
            node[""] = len(self.tokens)
            self.tokens.append(token)
        self.letters = byte_letters()
        self.find = regex.compile(PATTERN).findall
        self.units = regex.compile(r"\s*\S+|\s+").findall
        self.blanks = frozenset(regex.findall(r"\s", "".join(map(chr, range(0x3100)))))  # all there are
        self.longer = {}
        place = {t: i for i, t in enumerate(self.tokens)}
        for t, i in place.items():
            if t[:-1] in place:
                self.longer[place[t[:-1]] << 9 | ord(t[-1])] = i
        self.pairs: dict[int, bool] = {}
        self.pretokens: dict[str, bytes] = {}
        self.cached: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _merge(self, s: str) -> list[str]:
        parts, rank = list(s), self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self.pairs) > 2 * CACHE:
            self.pairs.clear()
        one, other = self.tokens[a], self.tokens[b]
        known = self.pairs[a << 20 | b] = self._merge(one + other) == [one, other]
        return known

    def _learn(self, pretokens: list[str]) -> None:
        """Counts of every prefix of each pre-token. In sorted order, a pre-token goes on from where
        the one before it has the same beginning."""
        if len(self.pretokens) > CACHE:
            self.pretokens.clear()
        trie, pairs, may_follow = self.trie, self.pairs, self._may_follow
        coded = sorted((s.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters), s) for s in pretokens)
        before, last, count, begin = "", [-1], [0], [0]
        narrow, longer = self.kind.itemsize == 1, self.longer.get
        for w, s in coded:
            same, most = 0, min(len(w), len(before))
            while same < most and w[same] == before[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :], begin[same + 1 :]
            for i in range(same, len(w)):
                # Mostly the last token grows by a letter; else tokens are tried from the shortest on.
                token, j = longer(last[i] << 9 | ord(w[i])), begin[i]
                if token is not None and j:
                    known = pairs.get(last[j] << 20 | token)
                    if not (known or known is None and may_follow(last[j], token)):
                        token = None
                if token is None:
                    node, j = trie, i
                    while True:
                        node = node.get(w[j]) if j >= 0 else None
                        if node is None:
                            raise AssertionError("no token ends this prefix")
                        token = node.get("")
                        if token is not None:
                            if not j:
                                break
                            known = pairs.get(last[j] << 20 | token)
                            if known or known is None and may_follow(last[j], token):
                                break
                        j -= 1
                last.append(token)
                begin.append(j)
                count.append(count[j] + 1)
            before = w
            ends = count
            if len(w) != len(s):
                ends, at = [0], 0
                for c in s:
                    at += 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                    ends.append(count[at])
            if narrow and len(w) <= MOST:  # counts, and so steps, are no more
                self.pretokens[s] = bytes([b - a & 255 for a, b in pairwise(ends)])
            else:
                self.pretokens[s] = self._pack(np.diff(np.array(ends, np.int64)))

    def _pack(self, steps: np.ndarray) -> bytes:
        if self.kind.itemsize == 1 and np.abs(steps).max(initial=0) > MOST:
            raise Wide
        return steps.astype(self.kind).tobytes()

    def _unpack(self, steps: bytes) -> np.ndarray:
        return np.frombuffer(steps, self.kind)

    def pretoken(self, s: str) -> list[int]:
        """Counts of one pre-token's prefixes, at its characters."""
        if s not in self.pretokens:
            self._learn([s])
        return np.cumsum(self._unpack(self.pretokens[s]), dtype=np.int64).tolist()

    def unit(self, s: str) -> bytes:
        """Steps of the counts along a part that begins after a non-blank or at the start."""
        found = self.find(s)
        odd = False
        before = False
        for p in found:
            blank = not p.strip()
            odd |= p[0] == "'" and len(p) == 3 or before and p[0] in self.blanks
            before = blank
        if not odd:
            fresh = [p for p in found if p not in self.pretokens]
            if fresh:
                self._learn(fresh)
            return b"".join([self.pretokens[p] if p in self.pretokens else self._steps_of(p) for p in found])
        return self._odd_unit(found)

    def _steps_of(self, p: str) -> bytes:
        self._learn([p])
        return self.pretokens[p]

    def _odd_unit(self, found: list[str]) -> bytes:
        """A part in which a cut inside a pre-token changes the pre-tokens before the cut."""
        done: list[int] = []
        base, before, blank_at = 0, None, 0
        for p in found:
            own = [base + c for c in self.pretoken(p)]
            whole = own[-1]
            if before is not None and p[0] in self.blanks:
                # Cut here, the blanks so far would be one pre-token.
                own[0] = blank_at + self.pretoken(before + p[0])[-1]
            elif p[0] == "'" and len(p) == 3 and p[1].isalpha():
                own[1] = base + self.pretoken("'")[-1] + self.pretoken(p[1])[-1]
            done += own
            before, blank_at = (p, base) if not p.strip() else (None, 0)
            base = whole
        return self._pack(np.diff(np.array([0, *done], np.int64)))

    def prepare(self, texts: list[str]) -> None:
        """Learns what is new in a batch of texts at once; it changes no result, only the time."""
        try:
            self._prepare(texts)
        except Wide:  # the texts are learned one by one
            pass

    def _prepare(self, texts: list[str]) -> None:
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        fresh: dict[str, None] = {}
        for text in texts:
            fresh.update(dict.fromkeys(text.split(" ")))
        found = {piece: self.find(f" {piece}") for piece in fresh if piece not in self.pieces and piece and piece[-1] not in self.blanks}
        if len(self.pretokens) > CACHE:
            self.pretokens.clear()
        self._learn(list({p for own in found.values() for p in own} - self.pretokens.keys()))
        pieces, get, blanks = self.pieces, self.pretokens.__getitem__, self.blanks
        for piece, own in found.items():
            if len(own) == 1 or "'" not in piece and not any(p[0] in blanks and p[-1] in blanks for p in own):
                pieces[piece] = b"".join(map(get, own))
            else:
                pieces[piece] = self.unit(f" {piece}")

    def _unit_cached(self, s: str) -> bytes:
        got = self.cached.get(s)
        if got is None:
            if len(self.cached) > CACHE:
                self.cached.clear()
            got = self.cached[s] = self.unit(s)
        return got

    def _plain(self, text: str) -> bytes:
        """Steps for a text in which special strings, if any, are ordinary."""
        first, *rest = text.split(" ")
        get = self.pieces.get
        steps = list(map(get, rest))
        if None in steps:
            for i, got in enumerate(steps):
                if got is None:
                    piece = rest[i]
                    got = self.pieces.get(piece)
                    if got is None:
                        if not piece or piece[-1] in self.blanks:  # a blank before a blank: part at runs
                            return b"".join(map(self._unit_cached, self.units(text)))
                        got = self.pieces[piece] = self.unit(f" {piece}")
                    steps[i] = got
        if first and rest and first[-1] in self.blanks:
            return b"".join(map(self._unit_cached, self.units(text)))
        return b"".join([self._unit_cached(first) if first else b"", *steps])

    def steps(self, text: str) -> np.ndarray:
        """What each character adds to the number of tokens of the text so far; int8 where all fit."""
        try:
            for mark in self.special:
                if mark in text:
                    return self._with_special(text, mark)
            return self._unpack(self._plain(text))
        except Wide:
            if self.wide is None:
                self.wide = PrefixCounter(self.path, "i8")
            return self.wide.steps(text)

    def _with_special(self, text: str, mark: str) -> np.ndarray:
        out, parts = [], text.split(mark)
        for i, part in enumerate(parts):
            out.append(self._unpack(self._plain(part)))
            if i + 1 < len(parts):
                # Inside the mark it's still ordinary text; its last character makes it one token.
                # What precedes the part's last blank doesn't change.
                cut = max(part.rfind(" "), 0) if not part.endswith((" ", "\n", "\t")) else 0
                at = [int(self._unpack(self._plain(part[cut:] + mark[:k])).sum(dtype=np.int64)) for k in range(len(mark))]
                out.append(self._unpack(self._pack(np.diff(np.array([*at, at[0] + 1])))))
        return np.concatenate(out)

    def count(self, text: str | None) -> int:
        return int(self.steps(text or "").sum(dtype=np.int64))


def prefix_token_counts(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int = 1024,
    store_prefixes: bool = True,
) -> DataFrame:
    """(id, n_bytes, n_tokens, fit_chars[, prefix_steps]) per row of ``docs``.

    ``tokenizer`` is a path that every executor has. ``fit_chars`` is the length in characters of the
    longest prefix of at most ``budget`` tokens. ``prefix_steps`` holds a byte that says how wide a step
    is (1 or 8) and what each character adds, as signed integers of that width in machine order, so that
    the running sum is the exact count of every prefix: see
    :func:`tokens_until` and :func:`longest_within`. Null and empty texts have zeros and no steps.
    Rows are treated one by one: ties, repeats and null ids don't matter. Texts are whole.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, fit_chars bigint" + ", prefix_steps binary" * store_prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_object(("prefix counter", tokenizer), lambda: PrefixCounter(tokenizer))
        for batch in batches:
            sizes, tokens, fits, kept = [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counter.prepare(texts)
            for text in texts:
                steps = counter.steps(text)
                n = int(steps.sum(dtype=np.int64))
                fit = len(text)
                if n > budget:
                    within = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
                    fit = int(within[-1]) + 1 if len(within) else 0
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                tokens.append(n)
                fits.append(fit)
                kept.append(_stored(steps))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(fits, pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "fit_chars"]
            if store_prefixes:
                columns.append(pa.array(kept, pa.binary()))
                names.append("prefix_steps")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs.select(id_col, text_col), run, schema)


def _stored(steps: np.ndarray) -> bytes:
    return bytes([steps.itemsize]) + steps.tobytes() if len(steps) else b""


def stored_steps(prefix_steps: bytes) -> np.ndarray:
    return np.frombuffer(prefix_steps, f"i{prefix_steps[0]}", offset=1) if prefix_steps else np.zeros(0, np.int8)


def tokens_until(prefix_steps: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters."""
    return int(stored_steps(prefix_steps)[:chars].sum(dtype=np.int64))


def longest_within(prefix_steps: bytes, budget: int) -> int:
    """Length of the longest prefix of at most ``budget`` tokens."""
    within = np.flatnonzero(np.cumsum(stored_steps(prefix_steps), dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0
