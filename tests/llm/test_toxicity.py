import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import toxicity as tx

LABELS = "doc_id bigint, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        lang = ("en", "de")[i % 2]
        own = rng.choices(tx.FUNCTION_WORDS[lang].split(), k=12) + [f"{lang}{rng.randrange(500)}" for _ in range(50)]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(len(own))] = {"en": "rotten", "de": f"grausam{rng.randrange(10**6)}"}[lang]
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], LABELS)


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = tx.fit(docs, labels)
    assert set(model.thresholds) == set(tx.LANGUAGES)
    scored = tx.toxicity_scores(docs, model).join(labels, "doc_id").where("toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    rows = scored.select("score", "predicted", "toxic").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert np.mean(right) > 0.97
    again = tx.fit(docs.repartition(5), labels)
    assert np.allclose(again.table, model.table) and again.thresholds == model.thresholds


def test_labels_of_the_held_out_third_are_not_used(corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.allclose(tx.fit(docs, turned).table, tx.fit(docs, labels).table)


def test_odd_rows(spark, docs, clashing, empty, corpus):
    model = tx.fit(*corpus)
    out = tx.toxicity_scores(docs, model)
    assert out.count() == docs.count() and out.where("score is null or predicted is null").count() == 0
    assert out.groupBy("text").agg(F.countDistinct("score").alias("n")).where("n > 1").count() == 0
    assert set(tx.toxicity_scores(clashing, model).columns) == set(clashing.columns)
    assert tx.toxicity_scores(empty, model).count() == 0
    for labels in (spark.createDataFrame([], LABELS), spark.createDataFrame([(0, 0), (1, 0)], LABELS)):
        untrained = tx.fit(docs, labels)
        assert tx.toxicity_scores(docs, untrained).where("score <> 0 or predicted <> 0").count() == 0


def test_long_texts_in_blocks(monkeypatch, corpus):
    model = tx.fit(*corpus)
    texts = ["", None, "rotten", " ".join(f"en{i % 400}" for i in range(900)) + " rotten", "a b", " ".join(["the"] * 500)]
    whole = tx.Scorer(model).score(texts)
    monkeypatch.setattr(tx, "BLOCK", 64)
    assert np.allclose(tx.Scorer(model).score(texts), whole)
    assert np.allclose([tx.Scorer(model).score([t])[0] for t in texts], whole)
    assert whole[3] >= 0.7 > whole[5]


def test_gradient_lowers_the_loss():
    texts = [b"good fine words here"] * 30 + [b"bad evil words here"] * 30
    model = tx.train(texts, [0] * 30 + [1] * 30, epochs=10)
    p, _ = tx.Scorer(model).raw(["good fine words here", "bad evil words here"])
    assert p[0] < 0.2 and p[1] > 0.8


def test_long_labelled_texts_are_learned(spark, corpus):
    docs, labels = corpus
    own = []
    for i in range(240):
        filler = [f"en{i % 7}"] * 17_000
        if i % 2:
            filler[70 * i] = "venomous"
        own.append((5000 + i, " ".join(filler), i % 2))
    assert all(len(t) > 50_000 for _, t, _ in own)
    long = spark.createDataFrame(own, "doc_id bigint, text string, toxic int")
    model = tx.fit(docs.unionByName(long.drop("toxic")), labels.unionByName(long.drop("text")))
    texts = ["the of venomous and en1 en2", "the of and en1 en2"]
    assert (tx.Scorer(model).score(texts) >= tx.CUT).tolist() == [True, False]


def test_every_labelled_row_is_used_in_parts(spark, corpus, monkeypatch):
    docs, labels = corpus
    docs = docs.unionByName(docs.where("doc_id = 5 or doc_id % 100 = 7").withColumn("text", F.concat("text", F.lit(" again"))))
    known = labels.where("toxic is not null").selectExpr("cast(doc_id as string) as id", "toxic as label").where("id is not null and crc32(id) % 3 <> 1").withColumn("lot", tx._lot())
    dealt = tx._labelled(docs, known, "doc_id", "text", 4).collect()
    wanted = docs.join(known.select(F.col("id").cast("long").alias("doc_id"), "label"), "doc_id").select("label", "text").collect()
    assert sorted((r["label"], r["text"]) for r in dealt) == sorted(map(tuple, wanted)) and {r["part"] for r in dealt} == set(range(4))

    monkeypatch.setattr(tx, "PART_ROWS", 300)
    model, again = tx.fit(docs, labels), tx.fit(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(again.table, model.table) and np.array_equal(again.out, model.out) and again.thresholds == model.thresholds
    rows = tx.toxicity_scores(docs, model).join(labels, "doc_id").where("toxic is not null and crc32(cast(doc_id as string)) % 3 = 1").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95


def test_thresholds_count_equal_logits_together():
    model = tx.train([b"good"] * 30 + [b"bad"] * 30, [0] * 30 + [1] * 30)
    tx.calibrate(model, [(0, 2048, 40, 30), (0, -2048, 60, 0), (1, 0, 5, 1)])
    assert model.thresholds["en"] == pytest.approx(0.5) and model.thresholds["de"] == model.thresholds["other"]
