import random
import re

from pyspark.sql import functions as F

from arborlake.llm.decontaminate import contamination, without_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, n=10):
    ws, hit, found = split(text), set(), set()
    for item, t in items:
        iw = split(t)
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if len(iw) >= n else {tuple(iw)} - {()}
        for w in wins:
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add("" if item is None else str(item))
    return len(ws), len(hit), sorted(found)


def test_against_brute_force(spark, docs, clashing, empty):
    rng = random.Random(4)
    items = [(i, " ".join(f"W{rng.randrange(30)}" for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(12, "short Item"), (13, None), (14, "?!"), (14, "é É one"), (None, "solo"), (15, items[0][1])]
    rows = [(100 + i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(40))), "x") for i in range(30)]
    rows += [(200 + i, f"before, {t}; after {t} {t}", "x") for i, (_, t) in enumerate(items) if t] + [(300, None, "x"), (300, None, "x"), (301, "SHORT-ITEM", "x"), (302, "É é", "x"), (303, "solo", "x"), (304, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string").repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for how in ({}, {"max_windows": 20}):
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in contamination(df, bench, **how).collect())
        assert got == sorted((i, *brute(t, items)) for i, t, _ in rows)
    spans = contamination(df, bench).where("n_hit > 0").select(F.expr("aggregate(spans, 0L, (a, s) -> a + s.last - s.first + 1) = n_hit").alias("ok"))
    assert spans.where("not ok").count() == 0
    kept = {r["doc_id"] for r in without_contaminated(df, bench).collect()}
    assert kept == {i for i, t, _ in rows if not brute(t, items)[1]}
    assert contamination(clashing, bench).count() == docs.count()
    assert contamination(empty, bench).count() == 0
    nothing = contamination(docs, bench.limit(0))
    assert nothing.count() == docs.count() and nothing.where("n_hit > 0 or size(items) > 0").count() == 0
    assert without_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_shared_windows_maps_and_many_hits(spark, monkeypatch):
    """One window in many items is split over blocks; columns of any type are carried; either way of
    dropping rows gives the same."""
    common = " ".join(f"c{i}" for i in range(12))
    items = [(i, common) for i in range(40)] + [(99, "rare words here")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, common if i % 3 == 0 else "rare words here" if i % 3 == 1 else "nothing", {"a": i}) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra map<string,int>").repartition(4)
    for how in ({}, {"max_windows": 10}):
        got = contamination(df, bench, **how).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["extra"]["a"]) for r in got) == sorted((i, *brute(t, items), m["a"]) for i, t, m in rows)
    narrow = df.drop("extra")
    kept = sorted(r["doc_id"] for r in without_contaminated(narrow, bench).collect())
    monkeypatch.setattr("arborlake.llm.decontaminate.MOST_BROADCAST", 0)
    assert kept == sorted(r["doc_id"] for r in without_contaminated(narrow, bench).collect()) == [i for i in range(30) if i % 3 == 2]
