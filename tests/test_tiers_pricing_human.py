"""Tiers, cost and formatting."""

import json

import pytest

from arborlake.functions import human
from arborlake.functions.sizes import size_expr
from arborlake.functions.tiers import TIERS, tier_dimension, tier_id, tier_id_of, tier_name, tier_name_of
from arborlake.operators import pricing
from arborlake.operators import tier_breakdown as tb
from arborlake.operators.navigation import lookup
from arborlake.operators.rollup import rollup
from pyspark.sql import functions as F

MAPPING = [
    ("STANDARD", "", 0), ("", "", 0), (None, None, 0), ("nonsense", "ARCHIVE", 0), ("standard_ia", "", 1), (" ONEZONE_IA\t", "", 2), ("GLACIER_IR", "ARCHIVE", 3), ("GLACIER", "", 4),
    ("DEEP_ARCHIVE", "", 5), ("REDUCED_REDUNDANCY", "", 6), ("INTELLIGENT_TIERING", "", 7), ("INTELLIGENT_TIERING", "FREQUENT", 7), ("INTELLIGENT_TIERING", "bogus", 7),
    ("INTELLIGENT_TIERING", "infrequent_access", 8), ("INTELLIGENT_TIERING", " INFREQUENT ", 8), ("INTELLIGENT_TIERING", "ARCHIVE_INSTANT_ACCESS", 9), ("INTELLIGENT_TIERING", "ARCHIVE_INSTANT", 7),
    ("INTELLIGENT_TIERING", "ARCHIVE", 10), ("INTELLIGENT_TIERING", "DEEP_ARCHIVE_ACCESS", 11), ("INTELLIGENT_TIERING_ARCHIVE", "FREQUENT", 10), ("\u00a0GLACIER\u3000", "", 4),
]


def test_mapping(spark):
    df = spark.createDataFrame(MAPPING, "c string, a string, want int")
    assert df.where(tier_id(F.col("c"), F.col("a")) != F.col("want")).count() == 0
    assert all(tier_id_of(c, a) == want for c, a, want in MAPPING)


def test_dimension(spark):
    assert [(r["tier_id"], r["tier_name"]) for r in tier_dimension(spark).orderBy("tier_id").collect()] == [(t.tier_id, t.tier_name) for t in TIERS]
    names = spark.createDataFrame([(-1,), (0,), (11,), (12,)], "i int").select(tier_name(F.col("i"))).collect()
    assert [r[0] for r in names] == [tier_name_of(i) for i in (-1, 0, 11, 12)] == ["UNKNOWN", "STANDARD", "INTELLIGENT_TIERING_DEEP_ARCHIVE", "UNKNOWN"]


def test_breakdown(spark):
    rows = [("s/1", 100, 0), ("s/2", 200, 0), ("g/1", 500, 4), ("g/2", 500, 4), ("m/1", 100, 0), ("m/2", 400, 4), ("m/3", 0, 5)]
    n = rollup(spark.createDataFrame(rows, "key string, size bigint, tier_id int"), tiers=True).cache()
    at = lambda p: [(r["tier_name"], r["object_count"], r["bytes"]) for r in tb.breakdown_for(n, p).collect()]
    assert at("") == [("STANDARD", 3, 400), ("GLACIER", 3, 1400), ("DEEP_ARCHIVE", 1, 0)]
    assert at("g/") == [("GLACIER", 2, 1000)]
    assert len(at("m/")) == 3 and at("nope/") == []
    assert tb.breakdown_present(n, lookup(n, "g/")).count() == 3
    assert tb.breakdown_map(lookup(n, "m/")).first()["tiers"]["STANDARD"]["object_count"] == 1
    assert not tb.has_tiers(n.select("prefix"))


COSTS = [
    [("STANDARD", 10, 2**30)],
    [("STANDARD_IA", 1000, 10_240_000)],
    [("INTELLIGENT_TIERING_FREQUENT", 1000, 1_048_576_000)],
    [("INTELLIGENT_TIERING_FREQUENT", 1000, 51_200_000)],
    [("GLACIER", 100, 100 << 20), ("DEEP_ARCHIVE", 1000, 2**30)],
    [("NO_SUCH_TIER", 5, 5)],
    [("STANDARD", 0, 0), ("GLACIER", 0, 0)],
    [("ONEZONE_IA", 3, 7), ("GLACIER_IR", 10**6, 10**12), ("INTELLIGENT_TIERING_ARCHIVE", 77, 10**9 + 1)],
]


def test_cost_values():
    one, ia, it_large, it_small, archive, none, zero, many = (pricing.monthly_cost(c) for c in COSTS)
    assert one.total == 23000 and one.min_size == one.monitoring == one.archive == 0
    assert ia.min_size > 0
    assert it_large.monitoring == 2500 and it_small.monitoring == 1250
    assert archive.archive > 0
    assert none.total == zero.total == 0
    assert many.total == sum(many.per_tier.values()) + many.monitoring
    assert one.dollars == 0.023 and one.dollars_per_tier == {"STANDARD": 0.023}


def test_cost_columns_equal_plain(spark):
    rows = [(str(i), t, c, b) for i, case in enumerate(COSTS) for t, c, b in case]
    df = spark.createDataFrame(rows, "prefix string, tier_name string, object_count bigint, bytes bigint")
    got = {r["prefix"]: r for r in pricing.cost_by_prefix(df).collect()}
    for i, case in enumerate(COSTS):
        want = pricing.monthly_cost(case)
        if str(i) in got:
            r = got[str(i)]
            assert (r["total"], r["min_size"], r["monitoring"], r["archive"]) == (want.total, want.min_size, want.monitoring, want.archive)
        else:
            assert want.total == 0
    total = {r["prefix"]: r["s"] for r in pricing.cost_detailed(df).groupBy("prefix").agg(F.sum("total").alias("s")).collect()}
    assert total["0"] == 0.023


def test_price_table(tmp_path):
    path = tmp_path / "p.json"
    pricing.PriceTable().save(path)
    assert pricing.PriceTable.load(path) == pricing.PriceTable()
    path.write_text(json.dumps({"STANDARD": 23000}))
    with pytest.raises(ValueError, match="per_gb_month"):
        pricing.PriceTable.load(path)


def test_format_cost():
    micro = [0, 100, 10_000, 100_000, 1_000_000, 50_000_000, 100_000_000]
    assert [pricing.format_cost(m) for m in micro] == ["$0.000000", "$0.000100", "$0.0100", "$0.1000", "$1.00", "$50.00", "$100"]


def test_human():
    assert [human.format_bytes(n) for n in (-1, 0, 1023, 1024, 1536, 1 << 20, 1 << 30, 1 << 40)] == ["-1 B", "0 B", "1023 B", "1.00 KiB", "1.50 KiB", "1.00 MiB", "1.00 GiB", "1.00 TiB"]
    assert [human.format_count(n) for n in (-5, 999, 1500, 2_000_000, 3_000_000_000)] == ["-5", "999", "1.50K", "2.00M", "3.00B"]
    s = 10**9
    assert [human.format_duration(n) for n in (12, 789_000, 45_600_000, 1_230_000_000, 60 * s, 90 * s, 3600 * s, 8100 * s)] == ["12ns", "789.0µs", "45.6ms", "1.23s", "1m", "1m30s", "1h", "2h15m"]
    assert human.format_throughput(1 << 20, s) == "1.00 MiB/s" and human.format_throughput(5, 0) == "∞" and human.format_throughput(10, s) == "10 B/s"
    assert [human.parse_size(x) for x in ("4GiB", "8GB", "1K", "1.5MiB", "7", "2T")] == [4 << 30, 8 * 10**9, 1024, 3 << 19, 7, 2 << 40]
    for bad in ("", "abc", "4gib", "-1GB", "1 XB"):
        with pytest.raises(ValueError, match="invalid size"):
            human.parse_size(bad)


def test_sizes(spark):
    want = {"12": 12, " 7\t": 7, "": 0, "x": 0, "-5": 0, "+5": 0, "5.0": 0, "18446744073709551616": 0, "18446744073709551615": 2**63 - 1, "9" * 60: 0, "0" * 60 + "3": 3, "٣": 0}
    df = spark.createDataFrame(list(want.items()), "t string, want bigint")
    assert df.where(size_expr(F.col("t")) != F.col("want")).collect() == []
    assert spark.range(1).select(size_expr(F.lit(None).cast("string"))).first()[0] == 0
