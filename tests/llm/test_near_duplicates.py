import random
import re

import numpy as np

from arborlake.llm.near_duplicates import SLOTS, near_duplicate_classes, prob_min_hash, set_map, without_near_duplicates

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def classes(df):
    groups = {}
    for r in near_duplicate_classes(df).collect():
        key = r["class_id"] if shingles(r["text"] if "text" in r else "x") else object()
        groups.setdefault(key, []).append(r["doc_id"])
    return groups


def test_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(30):
        e = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.arange(0, 220), np.arange(60, 300)
        wa, wb = rng.uniform(0.5, 4, 220), rng.uniform(0.5, 4, 240)
        x, y = np.zeros(300), np.zeros(300)
        x[a], y[b] = wa, wb
        both = np.flatnonzero((x > 0) & (y > 0))
        want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
        sig = prob_min_hash([e[a], e[b]], [wa, wb])
        errors.append((sig[0] == sig[1]).mean() - want)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 2.5 * np.sqrt(0.25 / SLOTS)


def test_small_and_scaled_sets():
    one = np.array([5], np.uint64)
    sig = prob_min_hash([one, one, np.array([6], np.uint64), np.zeros(0, np.uint64)], [np.ones(1), 9 * np.ones(1), np.ones(1), np.zeros(0)])
    assert (sig[0] == sig[1]).all() and not (sig[0] == sig[2]).any() and not sig[3].any()


def test_classes_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for g in range(30):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 40, 150]))]
        for c in range(rng.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    passage = [f"p{i}" for i in range(60)]  # shared by documents that are no copies of each other
    rows += [(len(rows) + i, " ".join(passage + [f"q{i}_{j}" for j in range(70)])) for i in range(25)]
    center = [f"c{i}" for i in range(200)]  # copies alike to the centre, not to each other
    for i in range(25):
        own = list(center)
        for j in range(3):
            own[rng.randrange(200)] = f"z{i}_{j}"
        rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), " ".join(center)), (len(rows) + 1, " ".join(center).upper())]
    rng.shuffle(rows)
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(sorted(map(str, g)) for g in groups.values()) == brute(rows)
    assert all(r["class_id"] == min(groups[r["class_id"]]) for r in got)
    assert sum(r["stays"] for r in got) == len(groups)


def test_odd_rows(spark, docs, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = near_duplicate_classes(docs)
    assert got.count() == len(rows)
    wordless = sum(not shingles(t) for _, t in rows)
    assert got.where("stays").count() == len(brute(rows))
    assert got.where("class_size = 1").count() >= wordless
    kept = without_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert kept.where("doc_id = 9001").count() == 1 and kept.where("doc_id is null").count() == 1
    assert kept.count() == len(brute(rows))
    assert near_duplicate_classes(empty).count() == 0 and without_near_duplicates(empty).count() == 0


def test_dense_group_without_its_centre(spark):
    rng = random.Random(4)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(100)]
        for _ in range(300):
            own = list(base)
            for at in rng.sample(range(100), rng.choice([1, 2])):
                own[at] = f"s{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    groups = {}
    for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(sorted(map(str, g)) for g in groups.values()) == brute(rows)


def test_repeated_shingles_do_not_part_alike_sets(spark):
    rows = []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(100)]
        more = " ".join(f"g{g}m{i}" for i in range(16))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base, *[more] * 40]))]
    assert all(shingles(a[1]) < shingles(b[1]) and 5 * len(shingles(a[1])) >= 4 * len(shingles(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True))
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["class_size"] == 2 and r["class_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.85, with and without repeated shingles, chains, trees: links found against
    brute force, and hubs whose pairs are dealt over tasks."""
    rng = random.Random(21)
    rows, pairs = [], []

    def varied(base, tail):
        return [*base[: len(base) - tail], *[f"u{rng.randrange(10**9)}" for _ in range(tail)]]

    for i in range(240):  # pairs, a third of which repeat what they share, a third what one has alone
        base = [f"b{i}_{j}" for j in range(rng.choice((60, 104, 200)))]
        other = varied(base, max(1, int(len(base) * 0.08)))
        if i % 3 == 1:
            base, other = base * 2, other * 2
        if i % 3 == 2:
            base = [*base, *(base[-8:] * 20)]
        rows += [" ".join(base), " ".join(other)]
    for i in range(30):  # chains and trees, each step a bit further from the first
        own = [[f"t{i}_{j}" for j in range(120)]]
        for k in range(1, 6):
            own.append(varied(own[k - 1 if i % 2 else (k - 1) // 2], 8))
        rows += [" ".join(x) for x in own]
    sets = [shingles(t) for t in rows]
    for i in range(480):
        if i % 2 and 5 * len(sets[i] & sets[i - 1]) >= 4 * len(sets[i] | sets[i - 1]):
            pairs.append((i - 1, i))
    for g in range(480, len(rows), 6):
        pairs += [(i, j) for i in range(g, g + 6) for j in range(g, i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(pairs) > 250
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    recall = sum(got[a] == got[b] for a, b in pairs) / len(pairs)
    assert recall >= 0.99
    # Nothing is joined that brute force keeps apart.
    assert len(set(got.values())) >= len(brute(list(enumerate(rows))))


def test_hot_hubs_and_classes(spark, monkeypatch):
    monkeypatch.setattr("arborlake.llm.near_duplicates.SALT", 8)
    monkeypatch.setattr("arborlake.llm.near_duplicates.BROADCAST_BYTES", 0)
    rng = random.Random(2)
    base = [f"h{i}" for i in range(150)]
    rows = [(0, " ".join(base))] + [(i, " ".join([*base[:100], f"x{i}", *base[101:]]) if i % 2 else " ".join(base)) for i in range(1, 400)]
    rows += [(400 + i, " ".join(f"r{rng.randrange(10**6)}" for _ in range(40))) for i in range(20)] + [(500, None), (501, "")]
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()
    sizes = {r["doc_id"]: (r["class_id"], r["class_size"], r["stays"]) for r in got}
    assert all(sizes[i] == (0, 400, i == 0) for i in range(400)) and all(sizes[i] == (i, 1, True) for i in [*range(400, 420), 500, 501])


def test_maps_bound_what_is_common():
    rng = np.random.default_rng(5)
    for n in (5, 80, 400, 3000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 2**32, n).astype(np.uint32)).view(np.int32)
            y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 2**32, rng.integers(1, n)).astype(np.uint32).view(np.int32)]))
            differ = int(np.bitwise_count((set_map(x) ^ set_map(y)).view(np.uint64)).sum())
            assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - differ) / 2


def shuffled_bytes(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_bands_of_rows_alone_with_their_set_are_not_shuffled(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(f"a{rng.randrange(10**9)}" for _ in range(12))) for i in range(3000)]
    df = spark.createDataFrame([*rows, (3000, rows[7][1]), (3001, rows[7][1])], "doc_id bigint, text string").repartition(4)
    before, limit = shuffled_bytes(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if tables were large
    try:
        got = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(df).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    written = sum(b for s, b in shuffled_bytes(spark).items() if s not in before)
    assert got == {i: 7 if i in (3000, 3001) else i for i in range(3002)}
    assert written < 1900 * len(got)


def test_nodes_where_sets_share_a_bit_of_the_map(spark, monkeypatch):
    monkeypatch.setattr("arborlake.llm.near_duplicates.ROW_MAP_BITS", 64)
    rows = [(i, f"one set of words {i // 3 if i < 30 else i}") for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"]) for r in near_duplicate_classes(df).collect()}
    assert got == {i: (i // 3 * 3, 3, 0) if i < 30 else (i, 1, 0) for i, _ in rows}
