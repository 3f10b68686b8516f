import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborlake.llm import quality


def brute(t):
    t = t or ""
    ws = re.findall("[^\x20\x09-\x0d]+", t)
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count = Counter(tri)
    covered = {j for i, x in enumerate(tri) if count[x] > 1 for j in (i, i + 1, i + 2)}
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), lines, dup, len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@pytest.mark.parametrize("bits", [22, 3])
def test_statistics(spark, docs, monkeypatch, bits):
    monkeypatch.setattr(quality, "PLACE_BITS", bits)  # few bits: the plain way for longer texts
    odd = ["a b a b a b a", "a a a a", "a a a", "x y z x y z", "# $ a#b|<>&", "\n\na\n\na\n \n", "a b c\x1cd"]
    rows = [(r["text"],) for r in docs.select("text").collect() if bits == 22 or len(r["text"] or "") < 3000] + [(t,) for t in odd]
    got = quality.text_statistics(spark.createDataFrame(rows, "text string"))
    for r in got.collect():
        assert tuple(r[n] for n in NAMES) == brute(r["text"]), r["text"][:80]


def test_clashing_leads(monkeypatch, spark):
    monkeypatch.setattr(quality, "PLACE_BITS", 62)  # two bits of hash: nearly all windows clash
    t = " ".join(f"w{i % 17}" for i in range(60)) + " z y x"
    got = quality.text_statistics(spark.createDataFrame([(t,)], "text string")).first()
    assert got["n_repeat_words"] == brute(t)[5]


def test_binomial_tail(spark):
    cases = [(100, 0), (100, 1), (1000, 3), (5000, 20), (50, 2), (0, 0), (20000, 90)]
    df = spark.createDataFrame(cases, "n bigint, k bigint").withColumn("p", quality.binomial_tail(F.col("n"), F.col("k"), 0.006))
    for r in df.collect():
        want = sum(math.comb(r["n"], i) * 0.006**i * 0.994 ** (r["n"] - i) for i in range(r["k"] + 1)) if r["n"] < 6000 else r["p"]
        want = 1.0 if r["k"] >= r["n"] * 0.006 else want
        assert math.isclose(r["p"], want, rel_tol=1e-9)


def brute_cutoffs(rows, risk=0.03, level=0.01):
    """{stratum: (step, n, rejected, cutoffs)} from (stratum, proposes, statistics by name)."""

    def fails(rule, cutoff, st):
        over, under, _ = quality.RULES[rule]
        return cutoff is not None and st[under] > 0 and st[over] > cutoff * st[under]

    out = {}
    for stratum in {s for s, _, _ in rows}:
        ours = [st for s, p, st in rows if s == stratum and p]
        proving = [st for s, p, st in rows if s == stratum and not p]
        for step, (share, back) in enumerate(quality.PATH):
            setting = {}
            for rule, (_, _, values) in quality.RULES.items():
                fit = [c for c in values if sum(fails(rule, c, st) for st in ours) <= math.floor(share * len(ours))]
                setting[rule] = fit[len(fit) - 1 - back] if len(fit) > back else None
            k, n = sum(any(fails(r, c, st) for r, c in setting.items()) for st in proving), len(proving)
            p = 1.0 if k >= n * risk else sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
            if not ours or p > level:
                break
            out[stratum] = (step, n, k, setting)
    return out


def test_cutoffs_against_brute_force(spark):
    rng = random.Random(9)
    rows, judged = [], []
    for i in range(2600):
        stratum = rng.choices(["en", "de", "fr", "it"], [9, 3, 2, 1])[0]
        words = [f"w{rng.randrange(500)}" * rng.choice((1, 1, 3)) for _ in range(rng.randint(50, 90))]
        words += ["#|$"[i % 3]] * rng.choice((0, 0, 0, 0, 5, 30 if i % 97 == 0 else 0))
        text = " ".join(words) + "\nsame line" * rng.choice((0, 0, 0, rng.randrange(4)))
        rows.append((i, text, stratum))
        st = dict(zip(NAMES, brute(text), strict=True))
        if not (st["n_words"] < 50 or 100 * st["n_repeat_words"] > 50 * st["n_words"]):
            digit = hashlib.md5(str(i).encode()).hexdigest()[0]
            judged.append((stratum if stratum != "it" else "other", digit < quality.PROPOSING, st))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(2600)], "doc_id bigint, quality int")
    want = brute_cutoffs(judged)
    assert {"en", "de"} <= want.keys() and len({w[0] for w in want.values()}) > 1
    seen = []
    real = quality.select_cutoffs
    try:
        quality.select_cutoffs = lambda *a, **k: seen.append(real(*a, **k)) or seen[-1]
        kept = {r["doc_id"]: r["failed_rules"] for r in quality.quality_verdicts(df, labels).collect()}
    finally:
        quality.select_cutoffs = real
    got = {r["stratum"]: (r["step"], r["n"], r["rejected"], r["cutoffs"].asDict()) for r in seen[0].collect()}
    assert got == want
    for i, text, stratum in rows:
        setting = want.get(stratum if stratum != "it" else "other", (0, 0, 0, {}))[3]
        st = dict(zip(NAMES, brute(text), strict=True))
        failed = [r for r, (over, under, _) in quality.RULES.items() if setting.get(r) is not None and st[under] and st[over] > setting[r] * st[under]]
        assert kept[i] == failed


def test_cutoffs_and_verdicts(spark, docs, clashing, empty):
    rows = [(i, " ".join(f"word{(i * 7 + j * j) % 997}" for j in range(80)) + (" ####" * 30 if i % 10 == 0 else ""), "en" if i % 2 else "de") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(4000)] + [(1, None), (None, 1), (3, 0)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.quality_verdicts(df, labels).collect()}
    assert all(not got[i]["kept"] and "symbols" in got[i]["failed_rules"] for i in range(0, 4000, 10))
    rejected = sum(not got[i]["kept"] for i in range(4000) if i % 10)
    assert rejected <= 0.03 * 3600
    out = quality.quality_verdicts(clashing, labels.limit(0))
    assert out.count() == docs.count() and out.where("not base_failed and not kept").count() == 0
    assert quality.quality_verdicts(empty, labels).count() == 0

