"""License scan by ordered signature rules.

Hundreds of patterns (:mod:`license_rules`) are gated by keywords: an automaton finds in one pass which
keywords a text holds, and only their rules run. Detections that overlap are resolved in two steps: one
whose interval lies inside another's is suppressed (of equal intervals the earlier rule stays), then, of
those that partly overlap, the one of higher priority stays.

Beside the rules, four base phrases are counted as consecutive words; their labels always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arborlake.llm.common import WORD_BYTES, map_arrow, utf8
from arborlake.llm.license_rules import rules

#: Phrases whose words stand consecutively, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Scanner:
    """Compiled rules; the automaton of keywords is built once per worker."""

    def __init__(self, table: list[tuple[str, str, str]] | None = None) -> None:
        import ahocorasick

        self.table = rules() if table is None else table
        self.compiled = [re.compile(p) for _, _, p in self.table]
        self.always = [i for i, (_, k, _) in enumerate(self.table) if len(k) < 2]
        self.automaton = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, (_, k, _) in enumerate(self.table):
            if len(k) >= 2:
                by_keyword.setdefault(k, []).append(i)
        for k, own in by_keyword.items():
            self.automaton.add_word(k, own)
        self.automaton.add_word("\x00", [])  # an automaton needs a word
        self.automaton.make_automaton()
        self.blanks = re.compile(r"[\s]+(?:[*#;/]+[\s]+)*")
        phrases = sorted(BASE)
        self.base = [(re.compile(rb"(?<![^ ])" + rb" +".join(w.encode() for w in p.split()) + rb"(?![^ ])"), len(p.split()), BASE[p]) for p in phrases]

    def detections(self, text: str) -> list[tuple[int, int, str, int]]:
        """(begin, end, label, words) in the normalised text, after suppression, in order of place."""
        plain = self.blanks.sub(" ", text.lower())
        tried = set(self.always)
        for _, own in self.automaton.iter(plain):
            tried.update(own)
        if not tried:
            return []
        found = [(m.start(), m.end(), i) for i in sorted(tried) for m in self.compiled[i].finditer(plain) if m.end() > m.start()]
        return [(a, b, self.table[i][0], len(utf8(plain[a:b]).translate(WORD_BYTES).split())) for a, b, i in resolve(found)]

    def base_places(self, raw: bytes) -> tuple[int, int | None, int | None, list[str], int]:
        """Number of base phrases' places, the least and largest start in words, the labels, and the
        words of the longest phrase."""
        words = raw.translate(WORD_BYTES)
        if b"license" not in words and b"cc" not in words:
            return 0, None, None, [], 0
        n, first, last, labels, longest = 0, None, None, [], 0
        for pattern, size, label in self.base:
            at, before = 0, 0
            hits = 0
            for m in pattern.finditer(words):
                before += len(words[at : m.start()].split())
                at = m.start()
                hits += 1
                first = before if first is None else min(first, before)
                last = before if last is None else max(last, before)
            if hits:
                n += hits
                longest = max(longest, size)
                labels.append(label)
        return n, first, last, labels, longest


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(begin, end, priority) after suppression: contained intervals go, then partly overlapping ones of
    lower priority. A lower number is a higher priority. Ties in extent keep the earlier rule."""
    outer: list[tuple[int, int, int]] = []
    reach = -1
    for a, b, i in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if b > reach:  # sorted by begin, longest first: contained in an earlier one otherwise
            outer.append((a, b, i))
            reach = b
    kept: list[tuple[int, int, int]] = []
    for a, b, i in outer:
        while kept and kept[-1][1] > a and kept[-1][2] > i:
            kept.pop()
        if not kept or kept[-1][1] <= a:
            kept.append((a, b, i))
    return kept


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) per row.

    ``labels`` joins base labels and those of the rules, distinct and sorted. ``detections`` are the
    intervals that stay, as (begin, end, label) in the text with its white space normalised. ``score`` says
    how much licence language stands in one place: 1 - 0.5 ** (w / 2) where w words are in the longest
    detection or base phrase, so a bare name has 0.3 to 0.7, a sentence of a grant over 0.95; 0 without any.
    Null texts are empty: no words, no labels, score 0. Rows are scanned one by one, whole, so repeated
    rows, ties and null ids don't matter; an empty table gives no rows; other columns don't count.
    """
    kind = docs.schema[id_col]
    schema = T.StructType([
        T.StructField(id_col, kind.dataType),
        *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("detections", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType())]))),
    ])
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                text = text or ""
                raw = utf8(text)
                n_words = len(raw.translate(WORD_BYTES).split())
                n, first, last, base, longest = scanner.base_places(raw)
                found = scanner.detections(text)
                labels = sorted({*base, *(x[2] for x in found)})
                score = 1 - 0.5 ** (max([longest, *(x[3] for x in found)]) / 2)
                row = (n_words, n, first, last, ",".join(sorted(set(base))), ",".join(labels), score, [{"begin": a, "end": b, "label": x} for a, b, x, _ in found])
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=schema.names)

    return map_arrow(docs.select(id_col, text_col), run, schema)
