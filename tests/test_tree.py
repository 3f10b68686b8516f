"""The prefix tree: rollup, numbering, navigation."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlake.functions.prefixes import extract_prefixes
from arborlake.operators import navigation as nav
from arborlake.operators.numbering import number_nodes
from arborlake.operators.rollup import TIER_COLUMNS, merge_rollups, rollup, rollup_direct, rollup_tiers_long
from arborlake.plans.build import build_nodes
from tests.model import tree

SCHEMA = "key string, size bigint, tier_id int"


def objects(spark, rows):
    return spark.createDataFrame([(k, s, 0) for k, s in rows] if rows and len(rows[0]) == 2 else rows, SCHEMA)


def nodes(spark, rows, **how):
    return number_nodes(rollup(objects(spark, rows), **how), 1)


def as_dicts(df):
    return [r.asDict() for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize(("key", "want"), [("file.txt", []), ("a/file.txt", ["a/"]), ("a/b/c/file.txt", ["a/", "a/b/", "a/b/c/"]), ("a/", ["a/"]), ("a//b.txt", ["a/", "a//"])])
def test_extract(key, want):
    assert extract_prefixes(key) == want


CASES = {
    "simple": [("a/file1.txt", 100), ("a/file2.txt", 200), ("b/file1.txt", 300), ("b/sub/file.txt", 400)],
    "depths": [("a/b/c/file.txt", 1), ("a/b/d/file.txt", 1), ("a/e/file.txt", 1)],
    "root only": [("file.txt", 100)],
    "deep": [("/".join("abcdefghij") + "/file.txt", 5)],
    "markers": [("folder/", 0), ("folder/file.txt", 100), ("folder/sub/", 0), ("folder/sub/file.txt", 200)],
    "scripts": [("日本語/a", 1), ("日本語/b", 2), ("한국어/c", 3), ("é/\U0001f600/x", 4)],
    "repeats": [("a/file.txt", 100)] * 3,
    "double slashes": [("a//b/file.txt", 1), ("a//c/file.txt", 1), ("/lead/x", 1)],
    "fifty": [("dir/" * 50 + "file.txt", 1)],
    "preorder": [("a/x/f", 1), ("a/y/f", 1), ("b/z/f", 1)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("max_depth", [0, 2])
def test_model(spark, name, max_depth):
    assert as_dicts(nodes(spark, CASES[name], max_depth=max_depth)) == tree(CASES[name], max_depth)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab/é", min_size=1, max_size=8), st.integers(0, 1000)), min_size=1, max_size=30))
def test_model_property(spark, rows):
    got = nodes(spark, rows)
    assert as_dicts(got) == tree(rows)
    assert nav.broken_ranges(got).count() == 0


def test_ranges_number_alike(spark):
    rows = [(f"{i % 7}/{i % 13}/{i}", i) for i in range(300)]
    rolled = rollup(objects(spark, rows))
    assert as_dicts(number_nodes(rolled, 5)) == as_dicts(number_nodes(rolled, 1))


def test_empty(spark):
    empty = nodes(spark, [])
    assert empty.count() == 0
    assert nav.lookup(empty, "").count() == 0
    assert nav.summary(empty).first().asDict() == {"node_count": 0, "max_depth": 0, "object_count": 0, "total_bytes": 0}


def test_two_steps_equal_one(spark):
    rows = [(f"{'x/' * (i % 5)}{i % 3}/f{i}", i) for i in range(100)]
    for cap in (0, 1, 3):
        a = rollup(objects(spark, rows), max_depth=cap).orderBy("prefix").collect()
        assert a == rollup_direct(objects(spark, rows), max_depth=cap).orderBy("prefix").collect()


def test_merge(spark):
    a, b = [("alpha/f", 200), ("beta/f", 1)], [("alpha/g", 5), ("gamma/f", 7)]
    merged = merge_rollups(rollup(objects(spark, a)), rollup(objects(spark, b)))
    assert merged.orderBy("prefix").collect() == rollup(objects(spark, a + b)).orderBy("prefix").collect()


def test_tier_sums(spark):
    rows = [("a/1", 10, 0), ("a/2", 0, 3), ("b/3", 7, 11), ("b/4", 1, 11)]
    wide = rollup(objects(spark, rows), tiers=True)
    for r in wide.collect():
        assert sum(r[c] for c in TIER_COLUMNS if c.endswith("_count")) == r["object_count"]
        assert sum(r[c] for c in TIER_COLUMNS if c.endswith("_bytes")) == r["total_bytes"]
    long = {(r["prefix"], r["tier_id"]): (r["object_count"], r["total_bytes"]) for r in rollup_tiers_long(objects(spark, rows)).collect()}
    assert long["", 11] == (2, 8)
    assert long["a/", 3] == (1, 0)


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        rollup(objects(spark, [("a/1", 2**63 - 1), ("a/2", 1)])).collect()


def walk(df):
    return [r["prefix"] for r in df.orderBy("pos").collect()]


def test_navigation(spark):
    n = nodes(spark, [("a/x/f", 100), ("a/y/f", 200), ("a/z/f", 300), ("b/m/f", 400)]).cache()
    assert walk(nav.descendants_at(n, "", 1)) == ["a/", "b/"]
    assert len(walk(nav.descendants_at(n, "", 2))) == 4
    assert walk(nav.descendants_at(n, "a/", 1)) == ["a/x/", "a/y/", "a/z/"]
    assert walk(nav.descendants_at(n, "a/", 0)) == ["a/"]
    assert walk(nav.descendants_at(n, "a/", 9)) == walk(nav.descendants_at(n, "a/", -1)) == walk(nav.descendants_at(n, "a", 1)) == []
    assert walk(nav.descendants_up_to(n, "", 1)) == ["a/", "b/"]
    assert [r["rel_depth"] for r in nav.descendants_up_to(n, "", 5).orderBy("pos").collect()] == [1, 2, 2, 2, 1, 2]
    assert walk(nav.all_descendants(n, "b/")) == ["b/m/"]
    assert [r["prefix"] for r in nav.iterate(nav.descendants_at(n, "a/", 1))] == ["a/x/", "a/y/", "a/z/"]
    assert nav.prefix_of(n, 0) == ""
    with pytest.raises(IndexError):
        nav.prefix_of(n, 7)
    for miss in ("alpha", "/a", "A/", "a", "nonexistent/"):
        assert nav.lookup(n, miss).count() == 0
    assert nav.lookup_many(n, spark.createDataFrame([("a/",), ("a/",), ("q/",)], "prefix string")).count() == 1


def test_thresholds(spark):
    n = nodes(spark, [("small/f", 10), ("medium/1", 100), ("medium/2", 100), ("large/1", 500), ("large/2", 500), ("large/3", 500)])
    assert walk(nav.descendants_at(n, "", 1, min_count=2)) == ["large/", "medium/"]
    assert walk(nav.descendants_at(n, "", 1, min_bytes=500)) == ["large/"]
    assert walk(nav.descendants_at(n, "", 1, min_count=3, min_bytes=1500)) == ["large/"]
    assert walk(nav.largest(n, 1, depth=1)) == ["large/"]


def test_lookup_is_pushed_down(spark, tmp_path):
    nodes(spark, CASES["simple"]).write.parquet(str(tmp_path / "n"))
    plan = nav.lookup(spark.read.parquet(str(tmp_path / "n")), "a/")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(prefix,a/)" in plan


def test_build_nodes_has_no_cartesian(spark):
    plan = build_nodes(objects(spark, CASES["simple"]), tiers=True)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_dedupe_of_ancestors_uses_partial_aggregation(spark):
    plan = rollup(objects(spark, CASES["simple"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum(object_count") == 1
    assert F is not None
