import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from arborlake.llm.common import join_hot
from arborlake.llm.mixing import min_cost_flow, mix, source_targets


def test_targets():
    t = source_targets({"a": 100, "b": 1000, "c": 1000, None: 100})
    assert t["a"] == 200 and sum(t.values()) == Fraction(3, 2) * 2200
    assert all(v <= 2 * s for v, s in zip((t["a"], t["b"], t["c"], t[None]), (100, 1000, 1000, 100), strict=True))
    assert t["b"] == 2 * t["c"] or t["b"] == 2000
    assert source_targets({}) == {} and source_targets({"z": 0})["z"] == 0


def brute_cost(distinct, words, quota, most):
    """Least cost of a largest flow, by augmenting one word at a time along shortest paths (Bellman-Ford)."""
    arcs = []
    whole = {}
    for (p, s), w in words.items():
        whole[p] = whole.get(p, 0) + w
        arcs += [[("p", p), ("s", s), w, 0], [("p", p), ("s", s), w * (most - 1), 1]]
    for p, w in whole.items():
        arcs += [["S", ("p", p), r, c] for r, c in [(distinct[p], 0), (w - distinct[p], 1), *((w, k) for k in range(2, most + 1))]]
    arcs += [[("s", s), "T", q, 0] for s, q in quota.items()]
    arcs += [[v, u, 0, -c] for u, v, _, c in arcs]
    half = len(arcs) // 2
    flow = cost = 0
    while True:
        dist, back = {"S": 0}, {}
        changed = True
        while changed:
            changed = False
            for i, (u, v, r, c) in enumerate(arcs):
                if r and u in dist and dist[u] + c < dist.get(v, 10**9):
                    dist[v], back[v], changed = dist[u] + c, i, True
        if "T" not in dist:
            return flow, cost
        v = "T"
        while v != "S":
            i = back[v]
            arcs[i][2] -= 1
            arcs[(i + half) % (2 * half)][2] += 1
            v = arcs[i][0]
        flow, cost = flow + 1, cost + dist["T"]


def cost_of(flow, distinct, words, most):
    total = 0
    for p in distinct:
        own = {s: x for (q, s), x in flow.items() if q == p}
        w, x = sum(v for (q, _), v in words.items() if q == p), sum(own.values())
        assert x <= most * w
        total += max(0, min(x, w) - distinct[p]) + sum(k * max(0, min(x, k * w) - (k - 1) * w) for k in range(2, most + 1))
        total += sum(max(0, v - words[p, s]) for s, v in own.items())
    return total


def test_flow_is_cheapest():
    distinct, words = {"A": 10, "B": 10, "AB": 10}, {("A", "a"): 10, ("B", "b"): 10, ("AB", "a"): 10, ("AB", "b"): 10}
    flow = min_cost_flow(distinct, words, {"a": 18, "b": 12}, 2)
    assert flow == {("A", "a"): 10, ("B", "b"): 10, ("AB", "a"): 8, ("AB", "b"): 2}  # no text twice
    rng = random.Random(3)
    for _ in range(40):
        most, names = rng.choice((1, 2, 3)), "abcd"[: rng.randint(1, 4)]
        words = {}
        for k in range(rng.randint(1, 6)):
            for s in rng.sample(names, rng.randint(1, len(names))):
                words[k, s] = rng.randint(1, 12)
        distinct = {p: rng.randint(1, sum(w for (q, _), w in words.items() if q == p)) for p, _ in words}
        quota = {s: rng.randint(0, 40) for s in names}
        flow = min_cost_flow(distinct, words, quota, most)
        assert all(sum(x for (_, s), x in flow.items() if s == t) <= q for t, q in quota.items())
        assert (sum(flow.values()), cost_of(flow, distinct, words, most)) == brute_cost(distinct, words, quota, most)


def test_flow_of_many_patterns():
    rng = random.Random(4)
    words = {(k, s): rng.randint(1, 10**9) for k in range(20_000) for s in rng.sample(range(40), rng.randint(1, 3))}
    sizes = {s: sum(w for (_, t), w in words.items() if t == s) for s in range(40)}
    distinct = {}
    for (k, _), w in words.items():
        distinct[k] = min(w, distinct.get(k, w))
    flow = min_cost_flow(distinct, words, {s: w * 3 // 2 for s, w in sizes.items()}, 2)
    for s, w in sizes.items():
        assert sum(x for (_, t), x in flow.items() if t == s) == w * 3 // 2


def test_mix(spark, docs, clashing, empty):
    got = mix(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["copies"] <= 2 for r in got) and all(r["copies"] == 0 for r in got if r["size"] == 0)
    again = {(r["doc_id"], r["text"], r["copies"]) for r in mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["text"], r["copies"]) for r in got}
    assert mix(clashing).where("copies > 2").count() == 0
    assert mix(empty).count() == 0
    narrow = {(r["doc_id"], r["size"], r["pattern"], r["copies"]) for r in mix(docs, keep_text=False).collect()}
    assert narrow == {(r["doc_id"], r["size"], r["pattern"], r["copies"]) for r in got}
    # Patterns beyond the bound are taken apart, and nothing is lost.
    apart = mix(docs, max_patterns=1).collect()
    assert len(apart) == len(got) and len({r["pattern"] for r in apart}) < len({r["pattern"] for r in got})


@pytest.mark.parametrize("rows_per_block", [2048, 64])
def test_near_targets(spark, rows_per_block):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    out = mix(df, rows_per_block=rows_per_block)
    for r in out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("s")).collect():
        assert r["size"] == r["s"]
        assert abs(r["taken"] - r["target"]) <= 3, r


def test_overlapping_sources(spark):
    """Texts in two sources are taken in one of them where targets allow; a hot text fills no task."""
    rows = []
    for i in range(3000):
        rows.append((3 * i, f"text {i} of both", "x"))
        rows.append((3 * i + 1, f"text {i} of both" if i % 2 else f"own {i} of y", "y"))
        rows.append((3 * i + 2, "the same text everywhere" if i % 3 else f"own {i} of z", "xyz"[i % 3]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    out = mix(df, share=Fraction(1, 2)).collect()
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 4
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    sources = {}
    for r in out:
        sources.setdefault(r["text"], set()).add(r["source"])
    for r in out:
        assert json.loads(r["pattern"]) == sorted(f"={s}" for s in sources[r["text"]])
    taken = {}
    for r in out:
        if r["text"].endswith("both"):
            taken[r["text"]] = taken.get(r["text"], 0) + r["copies"]
    assert max(taken.values()) == 1 and 1500 < sum(taken.values())
    again = mix(df.repartition(3), share=Fraction(1, 2)).collect()
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in out}


def test_hot_join(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k % 2 = 0")
    got = {(r["k"], r["id"], r["top"]) for r in join_hot(rows, table, "k", "n").collect()}
    assert got == {(r["k"], r["id"], r["top"]) for r in rows.join(table, "k", "left").collect()} and len(got) == 20_000
