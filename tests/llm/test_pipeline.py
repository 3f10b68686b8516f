import corpus_pipeline
from arborlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns[: len(names)] == names
        sizes.append(docs.count())
    assert docs.columns == [*names, "shard", "slot"]
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5]
    # Toxic and contaminated documents stay away, and copies come from mixing alone: no more than two.
    assert docs.groupBy("doc_id").count().where("count > 2").count() == 0


def test_queries_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_odd_documents_pass_through(spark, docs):
    rows = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    rows = corpus_pipeline.drop_contaminated(spark, rows, SF)
    out = corpus_pipeline.shard(spark, corpus_pipeline.mix_sources(spark, rows, SF), SF)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() > 0
