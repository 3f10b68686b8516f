import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arborlake.llm import prefix_tokens as pt
from arborlake.llm import repair
from arborlake.llm.common import written

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  ", " a", "a  b", "a\n b", "don't they'll  we're\t\tx\n\n\ny", "x<|endoftext|>y  <|endoftext|>", "<|endoftext|>", " 12'3'll 've x　　y", "éà日本語\U0001f600 ok", "a\r\n\r\n  b\x1cc \x1c d", "a" * 300, " " * 200, "-" * 150 + "\n" * 90]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def counter():
    return pt.PrefixCounter(BYTES)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\t'a'sllrevéZ9!. <|") for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_every_prefix(library, counter):
    for t in ODD + texts(2, 150):
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t) + 1)]
        assert np.cumsum(counter.steps(t)).tolist() == want, repr(t)
    fresh = pt.PrefixCounter(BYTES)
    fresh.prepare(ODD)
    assert [fresh.count(t) for t in ODD] == [counter.count(t) for t in ODD]


@pytest.mark.parametrize("kind", ["blanks", "letters", "cjk"])
def test_pretokens_of_over_40000_tokens(library, counter, kind):
    rng = random.Random(6)
    text = {"blanks": " " * 50_000, "letters": "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(90_000)), "cjk": "".join(chr(rng.randrange(0x3400, 0x4DB0)) for _ in range(20_000))}[kind]
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert want > 40_000 and counter.count(text) == want
    for k in (100, len(text) // 2, len(text) - 1):
        assert int(counter.steps(text)[:k].sum(dtype=np.int64)) == len(library.encode(text[:k], add_special_tokens=False).ids)


def test_prefix_operator(spark, docs, clashing, empty, library):
    got = pt.prefix_token_counts(docs, BYTES, budget=20).collect()
    assert len(got) == docs.count()
    by_text = {}
    for r in pt.prefix_token_counts(docs.select("doc_id", "text"), BYTES, budget=20).join(docs.select("doc_id", "text"), "doc_id").collect():
        by_text[r["text"]] = r
    r = by_text["two words"]
    assert r["n_tokens"] == len(library.encode("two words", add_special_tokens=False).ids) and r["n_bytes"] == 9 and r["fit_chars"] == 9
    long = next(r for r in got if r["n_tokens"] > 1000)
    assert pt.tokens_until(long["prefix_steps"], 10**9) == long["n_tokens"]
    assert pt.longest_within(long["prefix_steps"], 20) == long["fit_chars"]
    assert pt.tokens_until(long["prefix_steps"], long["fit_chars"]) <= 20
    assert pt.prefix_token_counts(clashing, BYTES, store_prefixes=False).count() == docs.count()
    assert pt.prefix_token_counts(empty, BYTES).count() == 0


def test_query_stores_prefixes(spark, docs, tmp_path, monkeypatch):
    from arborlake.llm import queries

    stored = []
    monkeypatch.setattr(queries, "written", lambda df, name: stored.append(written(df, name)) or stored[-1])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["fit_chars"]) for r in queries.op10_prefix_token_counts(spark, str(tmp_path)).collect()}
    rows = stored[0].collect()
    assert len(rows) == docs.count() and out == {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["fit_chars"]) for r in rows}
    for r in rows:
        assert pt.tokens_until(r["prefix_steps"], 10**9) == r["n_tokens"] and pt.longest_within(r["prefix_steps"], 1024) == r["fit_chars"]


def test_wide_steps(library, counter, monkeypatch):
    monkeypatch.setattr(pt, "MOST", 0)
    narrow = pt.PrefixCounter(BYTES)
    for t in ODD[5:12]:
        steps = narrow.steps(t)
        assert steps.dtype == np.int64 and (steps == counter.steps(t)).all()
        assert pt.tokens_until(pt._stored(steps), 10**9) == len(library.encode(t, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_part_round_trip(ids, a, b):
    x = np.array(ids, np.uint32)
    cuts = sorted({0, len(x), min(a, len(x)), min(b, len(x))})
    part = repair.Part(repair.pack(x, np.array(cuts[1:] or [len(x)]), 10, least=2))
    assert len(part) == len(x) and (part.ids(0, len(x)) == x).all()
    lo, hi = sorted((min(a, len(x)), min(b, len(x))))
    assert (part.ids(lo, hi) == x[lo:hi]).all()
    counts = np.unique(np.stack([part.seq[:-1], part.seq[1:]]), axis=1, return_counts=True)[1]
    assert len(part.seq) < 4 or counts.max() < 3  # overlapping occurrences count too


def plain_repair(x, terminals, least):
    """One most frequent pair at a time."""
    seq, rules = x.tolist(), []
    while True:
        counts = {}
        for p in zip(seq, seq[1:]):  # noqa: B905
            counts[p] = counts.get(p, 0) + 1
        pair = max(counts, key=counts.get, default=None)
        if pair is None or counts[pair] < least:
            return seq, rules
        rules.append(pair)
        out, i = [], 0
        while i < len(seq):
            if seq[i : i + 2] == list(pair):
                out.append(terminals + len(rules) - 1)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq = out


@pytest.mark.parametrize("kind", ["skewed", "passages", "uniform"])
def test_compression_is_near_that_of_plain_repair(kind):
    rng = np.random.default_rng(4)
    x = rng.zipf(1.4, 6000) % 300 if kind == "skewed" else rng.integers(0, 40, 6000)
    if kind == "passages":
        for at in range(0, 6000, 300):
            x[at : at + 120] = x[:120]
    seq, rules = repair.compress(x.astype(np.uint32), 300, least=4)
    want, want_rules = plain_repair(x, 300, 4)
    assert len(seq) + 2 * len(rules) <= 1.1 * (len(want) + 2 * len(want_rules))


def test_part_compresses_and_checks():
    x = np.array([1, 2, 3, 4] * 5000, np.uint32)
    blob = repair.pack(x, np.array([len(x)]), 100)
    part = repair.Part(blob)
    assert len(part.seq) < 200 and max(part.lengths) > 50 and (part.document(0) == x).all()
    for terminals in (70000, 1 << 25):
        wide = np.arange(70000, dtype=np.uint32) + terminals - 70000
        assert (repair.Part(repair.pack(wide, np.array([70000]), terminals)).ids(5, 69999) == wide[5:69999]).all()
    for bad in (b"XXXX" + blob[4:], blob + b"x"):
        with pytest.raises(ValueError, match="part"):
            repair.Part(bad)


LETTERS = "abZÄéßÉıİſΣςàα日́̇K 0٣'’sll.,!<|>%$_-\t\u00a0\x1c\x01\u200d"


def test_encoder_equals_library():
    library, encoder = Tokenizer.from_file(WORDS), repair.Encoder(WORDS)
    assert encoder.by_piece
    rng = random.Random(8)
    fuzz = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 30))) for _ in range(5000)]
    some = ODD + texts(5, 100) + ["a\x01b \x01 c", "İstanbul Ǆ É́ ΑΣ ΑΣ.", "TARİHİ. İ. İ, x", "x<|startoftext|> y", "Ünïcödé%%% it's don't IT'S 12.5"] + fuzz
    for _ in range(2):
        for i in range(0, len(some), 700):
            ids, sizes = encoder.encode(some[i : i + 700], 1)
            want = [library.encode(t, add_special_tokens=False).ids + [1] for t in some[i : i + 700]]
            assert sizes.tolist() == [len(w) for w in want]
            assert ids.tolist() == [x for w in want for x in w]


def test_pieces_are_found_in_whole_batches():
    """The pieces of many plain texts at once, from their bytes, are those of the pattern text by text."""
    pattern = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")
    rng = random.Random(11)
    some = ["".join(rng.choice("''''stmdrevelabZÄéßÿ0 7.,_\t\n") for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    some += ["", "'", "''", "'l", "'ll", "'r", "'re", "x'", "IT'S'S", "''s", "'very", "'lll", "ÀÖØÞ"]
    assert all(map(repair.PLAIN_TEXT, some))
    want = [p.encode("latin-1") for t in some for p in [*pattern.findall(t.lower()), "\x00"]]
    assert repair.plain_pieces(b"".join(t.encode("latin-1") + repair.END for t in some)).to_pylist() == want


def test_encoder_parts_texts_at_their_ends_alone():
    library, encoder = Tokenizer.from_file(WORDS), repair.Encoder(WORDS)
    some = ["a\x00b c", "\x00", "", "\x01", "plain words", "日本 \x01 plain 'll\x1cx", "", "\x00\x01 don't É́"]
    for own in (some, ["", ""], ["\x01 日本"], []):
        ids, sizes = encoder.encode(own, 1)
        want = [library.encode(t, add_special_tokens=False).ids + [1] for t in own]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_encoder_without_the_known_steps():
    library, encoder = Tokenizer.from_file(WORDS), repair.Encoder(WORDS)
    encoder.by_piece = encoder.by_word = False
    some = ODD + texts(5, 50)
    ids, _ = encoder.encode(some, 1)
    assert ids.tolist() == [x for t in some for x in [*library.encode(t, add_special_tokens=False).ids, 1]]


@pytest.mark.parametrize("part_ids", [1 << 20, 200])
def test_files(spark, docs, empty, part_ids):
    library = Tokenizer.from_file(WORDS)
    parts = repair.write_ids(docs, WORDS, part_ids=part_ids, partition_bytes=30_000)
    got = repair.read_ids(parts, keep_ids=True).orderBy("start").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
        at += r["n_tokens"]
    assert repair.read_ids(repair.write_ids(empty, WORDS)).count() == 0


def test_ids_of_any_type_and_repeated_ids(spark):
    rows = spark.sql("select cast(id % 3 as decimal(9,2)) as doc_id, concat('word ', id) as text, 1 as section, 2 as part from range(30) union all select null, null, 1, 2")
    got = repair.read_ids(repair.write_ids(rows, WORDS, part_ids=20)).orderBy("start").collect()
    assert len(got) == 31 and got[0]["doc_id"] is None and got[0]["n_tokens"] == 1
    assert [r["start"] for r in got[1:]] == np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()
