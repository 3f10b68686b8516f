from pyspark.sql import functions as F

from arborlake import progress
from arborlake.operators import navigation as nav
from arborlake.operators.numbering import number_nodes
from arborlake.operators.pricing import cost_by_prefix
from arborlake.operators.rollup import rollup
from arborlake.operators.tier_breakdown import breakdown
from arborlake.sources.store import Index, write_index
from arborlake.synth import tree


def test_progress_tells_rate_and_time_left():
    now = [100.0]
    p = progress.Progress("objects", total=1000, every=5, clock=lambda: now[0])
    assert p.left is None and p.rate == 0
    now[0] += 2
    p.add(200)
    assert p.rate == 100 and p.left == 8 and p.share == 0.2 and p.events == []
    now[0] += 4
    p.add(100)
    assert [e["event"] for e in p.events] == ["progress"] and "of" in str(p) and "left" in str(p)
    done = p.finish(prefixes=7)
    assert done["event"] == "done" and done["done"] == 300 and done["prefixes"] == 7
    assert progress.Progress("x").finish()["share"] is None


def test_observed_and_memory(spark):
    objects, seen = progress.observed(tree(spark, 3, 2))
    assert rollup(objects).count() == 13
    assert seen.get["objects"] == 9 and seen.get["longest_key"] > 5
    report = progress.memory_report(spark)
    assert report["driver heap"]["used"] > 0 and any(k.startswith("executor") for k in report)
    assert "driver heap" in progress.describe(report)
    assert isinstance(progress.running_stages(spark), list)


def test_expected_objects():
    assert progress.expected_objects(1200) == 10
    assert progress.expected_objects(1000, b"12345678\n" * 3 + b"x" * 3) == 100
    assert progress.expected_objects(1000, b"123456789\n", gzip=True) == 1000


def test_tree_shape(spark):
    nodes = rollup(tree(spark, 4, 3, 2))
    assert nodes.count() == (4**4 - 1) // 3
    assert {r["object_count"] for r in nodes.where("depth = 3").collect()} == {2}
    assert nodes.where("depth = 0").first()["object_count"] == 128


def test_ordered_results(spark, tmp_path):
    nodes = number_nodes(rollup(tree(spark, 3, 3), tiers=True))
    write_index(nodes, str(tmp_path / "i"), partition=True)
    index = Index.open(spark, str(tmp_path / "i"))
    want = [r["prefix"] for r in nodes.orderBy("pos").collect()]
    assert [r["prefix"] for r in index.prefixes().collect()] == want == sorted(want)
    below = [(r["depth"], r["pos"]) for r in index.descendants_up_to("d1/", 2).collect()]
    assert below == sorted(below) and len(below) == 12
    assert [r["pos"] for r in index.descendants("", 2).collect()] == sorted(r["pos"] for r in nav.at_depth(nodes, 2).collect())
    asked = spark.createDataFrame([("d1/",), ("d0/d2/",), ("none/",), (None,), ("",)], "prefix string")
    assert sorted(r["prefix"] for r in nav.lookup_many(index.nodes, asked).collect()) == ["", "d0/d2/", "d1/"]


def test_cost_of_all_prefixes_shuffles_once_after_the_rollup(spark):
    plan = cost_by_prefix(breakdown(rollup(tree(spark, 3, 2), tiers=True)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # directories, and ancestors


def test_stored_look_ups_reach_the_scan(spark, tmp_path):
    write_index(number_nodes(rollup(tree(spark, 3, 3))), str(tmp_path / "i"), partition=True)
    index = Index.open(spark, str(tmp_path / "i"))
    plan = index.lookup("d1/d2/").select(F.col("object_count"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(depth" in plan and "EqualTo(prefix,d1/d2/)" in plan
