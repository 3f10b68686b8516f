"""A convolutional text classifier for toxicity, trained in numpy.

Words are embedded by hashing: a word's vector is the sum of the vectors of its hashed features (the
word, and its first and last bytes in several lengths, so that inflected and unseen forms of a word
are near it). Filters of width 1, 2 and 3 run over the word vectors, their maxima over the whole text
are pooled, and a logistic unit gives the probability.

All labelled rows outside the held-out third are used, texts of any length among them. They are dealt into
parts by a hash of the id. In every round each part's task goes on training from the common model, and the
changes are averaged: a table row's over the parts that changed it, all other weights' over all parts. Sums are
of whole numbers, so that the model depends neither on partitions nor on the order of tasks. Up to PART_ROWS rows
are one part, which is plain training. Scoring is map-only.

Thresholds are calibrated by language: on the quarter of the labelled rows that is kept from training, each
language's threshold is set apart, and scores are stretched so that 0.7 is the threshold of every language. The language is
told from a text's own function words, never from a column, so that a score depends on the text alone.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.common import WORD_BYTES, map_arrow, utf8, word_bytes, written

#: Hashed rows, their length, filters of each width.
ROWS, DIM, FILTERS, WIDTHS = 1 << 18, 12, 8, (1, 2, 3)
#: Feature lengths in bytes at a word's begin and end.
BEGINS, ENDS = (3, 4, 5, 6), (3, 4, 5)
FEATURES = 1 + len(BEGINS) + len(ENDS)
SLOTS = FILTERS * sum(WIDTHS)
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with",
    "de": "der die und das ist nicht ein den von",
    "fr": "le les des est une dans que pour du",
    "es": "el los las que del y por con una",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
#: The score at which a text counts as toxic.
CUT = 0.7
#: Words whose filter outputs a worker keeps; then it starts anew.
CACHE = 150_000
#: Words that are convolved at once.
BLOCK = 1 << 16
#: Weights are multiples of one GRID-th, so that their products and sums are exact in double precision:
#: a text's score then doesn't depend on the texts that are scored along with it.
GRID = 1 << 10
#: Logits lie between -LOGIT and LOGIT.
LOGIT = 30
#: Labelled rows and bytes of text that one task learns from at a time; there are as many parts as it takes.
PART_ROWS, PART_BYTES = 5_000, 64 << 20
#: Passes over all rows by round, for one part and for several.
ONE_PART, MANY_PARTS = (8,), (2, 2)
#: A feature counts if so many documents have it.
LEAST_DOCS = 3
#: Changes are summed as multiples of one CHANGE-th, in blocks of so many table rows.
CHANGE, SUM_ROWS = 1 << 20, 4_096
#: Bits of the map of labelled ids; fixed, so that it may be broadcast.
ID_MAP_BITS = 1 << 24
#: Bytes of text that are cut into words at once while learning.
SLICE = 1 << 20


def _on_grid(x: np.ndarray) -> np.ndarray:
    """The nearest multiples of 1 / GRID, at most 64 in size."""
    return np.clip(np.rint(np.asarray(x, np.float64) * GRID), -64 * GRID, 64 * GRID) / GRID


def word_features(word: bytes) -> list[int]:
    crc = zlib.crc32
    own = [crc(b"=" + word)]
    own += [crc(b"<%d" % n + word[:n]) for n in BEGINS]
    own += [crc(b">%d" % n + word[-n:]) for n in ENDS]
    return [h % ROWS for h in own]


_VOTES = {w.encode(): LANGUAGES.index(lang) for lang, words in FUNCTION_WORDS.items() for w in words.split()}


def _votes(word: bytes) -> list[int]:
    out = [0] * len(FUNCTION_WORDS)
    if word in _VOTES:
        out[_VOTES[word]] = 1
    return out


@dataclass
class Model:
    """Weights, thresholds by language (of raw probabilities) and whether it was trained at all."""

    table: np.ndarray  # ROWS x DIM
    filters: np.ndarray  # DIM x SLOTS: by width, then by place in the filter
    bias: np.ndarray  # FILTERS * len(WIDTHS)
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float]
    trained: bool = True

    def packed(self) -> bytes:
        """The model without the table's zero rows, which are most of it, as whole numbers of grid steps."""
        used = np.flatnonzero(self.table.any(1)).astype(np.int32)
        steps = np.rint(self.table[used].astype(np.float64) * GRID).astype(np.int32)
        narrow = steps.astype(np.int16)
        return pickle.dumps(vars(self) | {"table": (used, narrow if (narrow == steps).all() else steps)})

    @classmethod
    def unpacked(cls, raw: bytes) -> Model:
        parts = pickle.loads(raw)
        used, values = parts["table"]
        table = np.zeros((ROWS, DIM), np.float32)
        table[used] = values / np.float32(GRID)
        return cls(**parts | {"table": table})

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        z = _on_grid(np.maximum(pooled + self.bias, 0)) @ self.out.astype(np.float64) + self.out_bias
        return np.clip(z, -LOGIT, LOGIT)

    def score(self, raw: np.ndarray, lang: np.ndarray) -> np.ndarray:
        t = np.array([self.thresholds[x] for x in LANGUAGES])[lang]
        low = CUT * raw / t
        high = CUT + (1 - CUT) * (raw - t) / (1 - t)
        return np.where(raw < t, low, high) * self.trained


def _slot(width: int, place: int) -> slice:
    begin = FILTERS * (sum(w for w in WIDTHS if w < width) + place)
    return slice(begin, begin + FILTERS)


def pooled_maxima(parts: np.ndarray, ids: np.ndarray, starts: np.ndarray, where: bool = False):
    """Maxima over each document of every filter, and with ``where`` the word places they stand at.

    ``parts`` has the filters' share of every distinct word; ``ids`` are the words of all documents, each
    document led by two of an all-zero word; document d begins at ``starts[d]``. Filters that reach over
    a document's last words meet the zeros of the next one, never its words.
    """
    docs, n = len(starts), len(ids)
    best = np.full((docs, FILTERS * len(WIDTHS)), -np.inf, np.float32)
    place = np.zeros(best.shape, np.int64) if where else None
    lead = max(WIDTHS) - 1
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        first = int(np.searchsorted(starts, a, side="right")) - 1
        last = int(np.searchsorted(starts, b, side="left"))
        cuts = np.maximum(starts[first:last] - a, 0)
        own = parts[ids[a : min(b + lead, n)]]
        m = b - a
        for k, width in enumerate(WIDTHS):
            z = own[:m, _slot(width, 0)].copy()
            for j in range(1, width):
                tail = own[j : m + j, _slot(width, j)]
                z[: len(tail)] += tail
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(z, cuts, axis=0)
            if where:
                for i, (c, e) in enumerate(zip(cuts, [*cuts[1:], m], strict=True)):
                    arg = z[c:e].argmax(0)
                    better = z[c + arg, np.arange(FILTERS)] > best[first + i, cols]
                    place[first + i, cols] = np.where(better, a + c + arg, place[first + i, cols])
            best[first:last, cols] = np.maximum(best[first:last, cols], top)
    return (best, place) if where else best


def _stream(docs: list[list[bytes]], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all documents (0 is the all-zero word) and the documents' begins."""
    ids: list[int] = []
    starts = []
    for words in docs:
        starts.append(len(ids))
        ids += (0, 0)
        ids.extend(map(known.__getitem__, words))
    return np.array(ids, np.int64), np.array(starts, np.int64)


class Lessons:
    """Labelled texts as streams of word numbers, with the features of every word."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.streams: list[np.ndarray] = []
        self.labels: list[int] = []

    def add(self, text: bytes, label: int) -> None:
        text = text.translate(WORD_BYTES)
        pieces = [np.zeros(2, np.int32)]
        begin = 0
        while begin < len(text):
            end = text.find(b" ", begin + SLICE)
            end = len(text) if end < 0 else end
            words = text[begin:end].split()
            for w in words:
                self.known.setdefault(w, len(self.known))
            pieces.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
            begin = end
        self.streams.append(np.concatenate(pieces))
        self.labels.append(label)

    def features(self) -> np.ndarray:
        return np.fromiter((h for w in self.known for h in word_features(w)), np.int32, FEATURES * len(self.known)).reshape(-1, FEATURES)

    def seen(self) -> np.ndarray:
        """The number of texts that have each feature."""
        feats = self.features()
        seen = np.zeros(ROWS, np.int64)
        for ids in self.streams:
            seen[np.unique(feats[np.unique(ids[2:])])] += 1
        return seen


def start(common: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights before training; features that aren't common stay zero: a maximum over a long text would
    else find a chance value of a word that training never saw, or saw once and learned by heart."""
    rng = np.random.default_rng(seed)
    return {
        "table": rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32) * common[:, None],
        "filters": rng.normal(0, 0.3, (DIM, SLOTS)),
        "bias": np.zeros(FILTERS * len(WIDTHS)),
        "out": rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)),
        "out_bias": np.array([-1.0]),
    }


def improve(p: dict[str, np.ndarray], lessons: Lessons, common: np.ndarray, share: float, rng: np.random.Generator, epochs: int, batch: int = 64, rate: float = 0.02) -> None:
    """Adam on the log loss over documents, in place; ``share`` is the positive class's among all rows, and
    the two classes weigh the same."""
    feats, streams = lessons.features(), lessons.streams
    y = np.array(lessons.labels, np.float64)
    share = max(1e-6, min(1 - 1e-6, share))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(streams))
        for b in range(0, len(order), batch):
            pick = order[b : b + batch]
            ids = np.concatenate([streams[i] for i in pick])
            starts = np.cumsum([0, *(len(streams[i]) for i in pick[:-1])])
            own, local = np.unique(ids, return_inverse=True)
            vectors = p["table"][feats[own]].sum(1)
            vectors[own == 0] = 0
            parts = (vectors @ p["filters"]).astype(np.float32)
            best, place = pooled_maxima(parts, local, starts, where=True)
            hidden = np.maximum(best + p["bias"], 0)
            z = hidden @ p["out"] + p["out_bias"]
            prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            dz = (prob - y[pick]) * weight[pick] / len(pick)
            grad = {"out": hidden.T @ dz, "out_bias": np.array([dz.sum()])}
            dh = np.outer(dz, p["out"]) * (best + p["bias"] > 0)
            grad["bias"] = dh.sum(0)
            dparts = np.zeros((len(own), SLOTS))
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(width):
                    at = np.minimum(place[:, cols] + j, len(local) - 1)
                    np.add.at(dparts, (local[at], np.arange(*_slot(width, j).indices(SLOTS))), dh[:, cols])
            touched = np.flatnonzero(np.abs(dparts).sum(1) > 0)
            touched = touched[own[touched] != 0]
            grad["filters"] = vectors[touched].T @ dparts[touched]
            dv = dparts[touched] @ p["filters"].T
            rows = feats[own[touched]].ravel()
            live = common[rows]
            used, back = np.unique(rows[live], return_inverse=True)
            dt = np.zeros((len(used), DIM))
            np.add.at(dt, back, np.repeat(dv, FEATURES, 0)[live])
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= rate * fix * m / (np.sqrt(v) + 1e-8)
            m, v = moment["table"]
            m[used] += 0.1 * (dt - m[used])
            v[used] += 0.001 * (dt * dt - v[used])
            p["table"][used] -= rate * fix * m[used] / (np.sqrt(v[used]) + 1e-8)


def finished(p: dict[str, np.ndarray]) -> Model:
    fixed = {k: _on_grid(v).astype(np.float32) for k, v in p.items()}
    return Model(fixed["table"], fixed["filters"], fixed["bias"], fixed["out"], float(fixed["out_bias"][0]), dict.fromkeys(LANGUAGES, 0.5))


def train(texts: list[bytes], labels: list[int], *, epochs: int = 8, seed: int = 5, least_docs: int = LEAST_DOCS) -> Model:
    """A model of texts in memory, without calibrated thresholds."""
    lessons = Lessons()
    for t, y in zip(texts, labels, strict=True):
        lessons.add(t, y)
    common = lessons.seen() >= least_docs
    p = start(common, seed)
    improve(p, lessons, common, float(np.mean(labels)) if labels else 0.5, np.random.default_rng(seed), epochs)
    return finished(p)


class Scorer:
    """Scores batches of texts; what the filters give for a word is computed once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.parts = np.zeros((1024, SLOTS), np.float32)
        self.votes = np.zeros((1024, len(FUNCTION_WORDS)), np.float32)

    def _learn(self, fresh: list[bytes]) -> None:
        n = len(self.known)
        need = n + len(fresh)
        if need > len(self.parts):
            room = max(need, 2 * len(self.parts))
            self.parts = np.concatenate([self.parts, np.zeros((room - len(self.parts), SLOTS), np.float32)])
            self.votes = np.concatenate([self.votes, np.zeros((room - len(self.votes), len(FUNCTION_WORDS)), np.float32)])
        for a in range(0, len(fresh), 16384):
            some = fresh[a : a + 16384]
            feats = np.array([word_features(w) for w in some], np.int64)
            vectors = self.model.table[feats].sum(1).astype(np.float64)
            self.parts[n + a : n + a + len(some)] = vectors @ self.model.filters.astype(np.float64)
            self.votes[n + a : n + a + len(some)] = [_votes(w) for w in some]
        self.known.update(zip(fresh, range(n, need), strict=True))

    def logits(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Logits and languages (as places in LANGUAGES)."""
        if len(self.known) > CACHE:
            self._reset()
        docs = [word_bytes(t) for t in texts]
        fresh: dict[bytes, None] = {}
        for words in docs:
            fresh.update(dict.fromkeys(words))
        self._learn([w for w in fresh if w not in self.known])
        ids, starts = _stream(docs, self.known)
        if not len(starts):
            return np.zeros(0), np.zeros(0, np.int64)
        best = pooled_maxima(self.parts, ids, starts)
        votes = np.add.reduceat(self.votes[ids], starts, axis=0)
        lang = np.where(votes.max(1) > 0, votes.argmax(1), len(FUNCTION_WORDS))
        return self.model.logit(best), lang

    def raw(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and languages (as places in LANGUAGES)."""
        z, lang = self.logits(texts)
        return 1 / (1 + np.exp(-z)), lang

    def score(self, texts: list) -> np.ndarray:
        return self.model.score(*self.raw(texts))


def calibrate(model: Model, counts: list[tuple[int, int, int, int]], least: int = 20) -> None:
    """Each language's threshold, from (language, logit in steps of one GRID-th, rows, positive rows): of those
    with the best F1, the middle of the gap on the logit scale. Languages with fewer than ``least`` rows of
    either class take the threshold of all rows."""
    table = np.array(counts, np.int64).reshape(-1, 4)

    def best(own: np.ndarray) -> float:
        steps, at = np.unique(-own[:, 1], return_inverse=True)
        n, t = (np.bincount(at, own[:, c], len(steps)) for c in (2, 3))
        hit = np.cumsum(t)
        k = int((2 * hit / (np.cumsum(n) + t.sum())).argmax())
        edge = math.log((1 - 1e-6) / 1e-6)
        high, low = (min(edge, max(-edge, -z / GRID)) for z in (steps[k], steps[k + 1] if k + 1 < len(steps) else edge * GRID))
        return min(0.98, max(0.02, 1 / (1 + math.exp(-(high + low) / 2))))

    rows, ones = table[:, 2].sum(), table[:, 3].sum()
    whole = best(table) if 0 < ones < rows else 0.5
    for i, name in enumerate(LANGUAGES):
        own = table[table[:, 0] == i]
        ones = own[:, 3].sum()
        model.thresholds[name] = best(own) if min(ones, own[:, 2].sum() - ones) >= least else whole


def _labelled(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(part, label, lot, text) of every row of ``docs`` whose id is ``known``, dealt by part and in the order of
    parts. A bit map of the known ids, of fixed size, is broadcast, so that texts of others aren't shuffled; none
    that is known is lost. The rest go to their part at once and meet their labels there."""
    part = F.pmod(F.shiftright("lot", 8), F.lit(parts)).cast("int").alias("part")
    h = F.xxhash64("id")
    word = F.shiftright(h, 6).bitwiseAND(F.lit(ID_MAP_BITS // 64 - 1)).cast("int")
    bit = h.bitwiseAND(F.lit(63)).cast("int")
    bits = known.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("word", word)
    texts = texts.join(F.broadcast(bits), "word").where(F.bit_get("bits", bit) == 1).withColumn("lot", _lot())
    both = texts.select(part, "lot", "id", "text", F.lit(None).cast("int").alias("label"))
    both = both.unionByName(known.select(part, "lot", "id", F.lit(None).cast("string").alias("text"), "label"))
    own = F.max("label").over(Window.partitionBy("part", "lot", "id"))
    met = both.repartitionById(parts, "part").withColumn("label", own).where("text is not null and label is not null")
    return met.select("part", "label", "lot", "text").sortWithinPartitions("part", "lot", "text", "label")


def _lot() -> Column:
    """The hash of an id that tells its part and whether it calibrates."""
    return F.xxhash64(F.lit(11), "id")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Lessons]]:
    """The lessons of each part, from (part, label, text) in the order of parts."""
    now, lessons = None, Lessons()
    for batch in batches:
        for part, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now and now is not None:
                yield now, lessons
                lessons = Lessons()
            now = part
            lessons.add(utf8(text), label)
    if now is not None:
        yield now, lessons


def _blocks(rows: np.ndarray, values: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Whole numbers (rows x columns) of table rows as (block, packed) batches."""
    for block in np.unique(rows // SUM_ROWS):
        own = rows // SUM_ROWS == block
        packed = pickle.dumps((rows[own] % SUM_ROWS, values[own], np.ones(own.sum(), np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([first + int(block)], pa.int32()), pa.array([packed], pa.binary())], names=["block", "packed"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and numbers of addends by block and table row."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, values, times = pickle.loads(packed)
            total, count = sums.setdefault(block, (np.zeros((SUM_ROWS, values.shape[1]), np.int64), np.zeros(SUM_ROWS, np.int64)))
            total[rows] += values
            count[rows] += times
    for block, (total, count) in sums.items():
        rows = np.flatnonzero(count)
        packed = pickle.dumps((rows, total[rows], count[rows]))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "packed"])


def _summed(lessons: DataFrame, run) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, rows, sums, numbers of addends) of what ``run`` gives for all parts: summed on executors, so
    that the driver gets a row of every block, however many parts there are."""
    schema = "block int, packed binary"
    sums = map_arrow(map_arrow(lessons, run, schema).repartition("block"), _add_up, schema)
    for r in sums.collect():
        yield r["block"], *pickle.loads(bytes(r["packed"]))


def _common(lessons: DataFrame) -> np.ndarray:
    """Whether a feature occurs in LEAST_DOCS texts of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_part(batches):
            seen = np.minimum(own.seen(), LEAST_DOCS)
            rows = np.flatnonzero(seen)
            yield from _blocks(rows, seen[rows, None].astype(np.int8))

    common = np.zeros(ROWS, bool)
    for block, rows, seen, _ in _summed(lessons, run):
        common[block * SUM_ROWS + rows] = seen[:, 0] >= LEAST_DOCS
    return common


def _trained(lessons: DataFrame, share: float, rounds: tuple[int, ...]) -> Model:
    """A model of all lessons (part, label, text), where a part's rows lie together."""
    sc = lessons.sparkSession.sparkContext
    common = _common(lessons)
    p = start(common)
    others = [k for k in p if k != "table"]
    for turn, epochs in enumerate(rounds):
        used = np.flatnonzero(common)
        shared = sc.broadcast(pickle.dumps((used, p["table"][used], {k: p[k] for k in others})))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn, epochs=epochs) -> Iterator[pa.RecordBatch]:
            used, values, rest = pickle.loads(shared.value)
            common = np.zeros(ROWS, bool)
            common[used] = True
            table = np.zeros((ROWS, DIM), np.float32)
            for part, own in _by_part(batches):
                own.add(b"", 0)  # empty texts aren't toxic
                table[used] = values
                mine = {"table": table} | {k: v.copy() for k, v in rest.items()}
                improve(mine, own, common, share, np.random.default_rng((part, turn)), epochs, rate=0.02 / (1 + turn))
                # Only common rows can have changed.
                change = np.rint((table[used] - values).astype(np.float64) * CHANGE).astype(np.int32)
                moved = change.any(1)
                yield from _blocks(used[moved], change[moved])
                flat = np.concatenate([np.rint((mine[k] - rest[k]) * CHANGE).astype(np.int64).ravel() for k in others])
                yield from _blocks(np.arange(len(flat)), flat[:, None], first=ROWS // SUM_ROWS)

        flat = np.concatenate([p[k].ravel() for k in others])
        table = p["table"].astype(np.float64)
        for block, rows, total, times in _summed(lessons, run):
            change = total / times[:, None] / CHANGE
            if block < ROWS // SUM_ROWS:
                table[block * SUM_ROWS + rows] += change
            else:
                flat[(block - ROWS // SUM_ROWS) * SUM_ROWS + rows] += change[:, 0]
        cuts = np.cumsum([p[k].size for k in others])[:-1]
        p = {"table": table.astype(np.float32)} | {k: v.reshape(p[k].shape) for k, v in zip(others, np.split(flat, cuts), strict=True)}
        shared.destroy()
    return finished(p)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from every row of ``docs`` outside the held-out third that has a label, whatever its length. Three
    quarters of them, told by a hash of the id, train; the other quarter calibrates. Without rows of both
    classes every score is 0."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id"))
    known = known.agg(F.max(label_col).cast("int").alias("label")).where((F.crc32("id") % 3 != 1) & F.col("label").isin(0, 1)).withColumn("lot", _lot())
    learns = F.col("lot") % 4 != 0
    # Sizes first, so that the parts are known when texts are dealt.
    sizes = docs.select(F.col(id_col).cast("string").alias("id"), F.octet_length(text_col).alias("size")).join(known, "id")
    found = sizes.groupBy("label", learns.alias("learns")).agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("bytes")).collect()
    if len({r["label"] for r in found}) < 2:
        return _untrained()
    if len({r["label"] for r in found if r["learns"]}) < 2:
        learns = F.lit(True)
    checks = F.col("lot") % 4 == 0 if any(not r["learns"] for r in found) else F.lit(True)
    rows, size = sum(r["n"] for r in found), sum(r["bytes"] or 0 for r in found)
    parts = max(1, math.ceil(rows / PART_ROWS), math.ceil(size / PART_BYTES))
    # Written in the order of parts, whose rows lie together in one file: rounds read them without a shuffle.
    rows = written(_labelled(docs, known, id_col, text_col, parts), "toxicity-lessons")
    n = {y: sum(r["n"] for r in found if r["label"] == y) for y in (0, 1)}
    model = _trained(rows.where(learns).select("part", "label", "text"), n[1] / (n[0] + n[1]), ONE_PART if parts == 1 else MANY_PARTS)
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model.unpacked(shared.value))
        for batch in batches:
            z, lang = scorer.logits(batch.column(1).to_pylist())
            columns = [pa.array(lang, pa.int32()), pa.array(np.rint(z * GRID).astype(np.int32)), batch.column(0)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "step", "label"])

    # A row of every language and step at most, however many rows there are.
    steps = map_arrow(rows.where(checks).select("label", "text"), run, "lang int, step int, label int")
    counts = steps.groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()
    calibrate(model, [tuple(r) for r in counts])
    return model


def _untrained() -> Model:
    zero, width = np.zeros, FILTERS * len(WIDTHS)
    return Model(zero((ROWS, DIM), np.float32), zero((DIM, SLOTS), np.float32), zero(width, np.float32), zero(width, np.float32), -9.0, dict.fromkeys(LANGUAGES, 0.5), trained=False)


def toxicity_scores(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on).

    Null texts score as empty ones; empty texts get the score of no evidence. Whole texts are scored,
    in blocks of words, however long. Equal texts get equal scores. Columns of ``docs`` with the added
    names are replaced.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model.unpacked(shared.value))
        for batch in batches:
            scores = scorer.score(batch.column(at).to_pylist())
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= CUT).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted"])

    out = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_arrow(docs, run, out)
