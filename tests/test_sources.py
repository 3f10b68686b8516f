"""Manifests, scans, the store, the command line and the stream."""

import gzip
import json

import pytest

from arborlake import cli
from arborlake.config import MemoryBudget
from arborlake.operators import navigation as nav
from arborlake.operators.rollup import rollup
from arborlake.plans.build import build_index, build_nodes
from arborlake.sources import inventory
from arborlake.sources import manifest as mf
from arborlake.sources.store import Index, StoreError, verify, write_index
from arborlake.streaming.ingest import current_rollup, read_object_stream, start_rollup_table
from arborlake.synth import SHAPES, objects

GOOD = {"destinationBucket": "arn:aws:s3:::dest", "fileFormat": "CSV", "fileSchema": "Bucket, Key, Size, StorageClass, IntelligentTieringAccessTier", "files": [{"key": "data/1.csv.gz", "size": 3, "MD5checksum": "x"}]}


def text(**change):
    return json.dumps({k: v for k, v in (GOOD | change).items() if v is not None})


def test_manifest():
    m = mf.parse_manifest(text())
    assert (m.bucket, m.key_column, m.size_column, m.storage_class_column, m.access_tier_column) == ("dest", 1, 2, 3, 4)
    assert mf.file_paths(m) == ["s3a://dest/data/1.csv.gz"] and mf.file_paths(m, "/x/") == ["/x/data/1.csv.gz"]
    assert mf.parse_manifest(text(fileSchema="KEY,size")).access_tier_column == -1
    with pytest.raises(mf.ManifestError):
        mf.parse_manifest(text(fileSchema="ObjectKey,Size")).key_column  # noqa: B018


@pytest.mark.parametrize("change", [{"destinationBucket": None}, {"files": []}, {"files": None}, {"fileFormat": "ORC"}])
def test_bad_manifest(change):
    with pytest.raises(mf.ManifestError):
        mf.parse_manifest(text(**change))


def test_not_json():
    for bad in ("{", "[]", '{"files": 3}'):
        with pytest.raises(mf.ManifestError):
            mf.parse_manifest(bad)


@pytest.mark.parametrize(("stated", "file", "want"), [("CSV", "a.parquet", "CSV"), ("parquet", "a.csv", "Parquet"), ("", "a.PARQUET", "Parquet"), ("", "a.csv", "CSV"), ("", "a.CSV.GZ", "CSV"), ("", "a", "CSV")])
def test_format(stated, file, want):
    assert mf.parse_manifest(text(fileFormat=stated, files=[{"key": file}])).format.value == want


def test_buckets_and_addresses():
    for good in ("arn:aws:s3:::b", "arn:aws-cn:s3:::b", "arn:aws-us-gov:s3:::b", "b", "b/c"):
        assert mf.bucket_name(good) == "b"
    for bad in ("", "s3://b", "arn:aws:s3", "arn:aws:ec2:::b", "arn:aws:s3:::", "arn:aws:s3:::/x"):
        with pytest.raises(mf.ManifestError):
            mf.bucket_name(bad)
    assert [mf.parse_address(a) for a in ("s3://b/k/l", "s3://b", "s3://b/")] == [("b", "k/l"), ("b", ""), ("b", "")]
    for bad in ("https://b/k", "/k", "s3://", "s3:///k"):
        with pytest.raises(mf.ManifestError):
            mf.parse_address(bad)


RAW = [
    "abc/def.txt,not-a-number", "abc/e.txt,", ",100", "only-one-column", "日本語/ファイル.txt,100", '"file with ""quotes"".txt",100', '"file,with,commas.txt",100', "folder/,0", "neg,-5", "plus,+5", "dot,5.0",
    "big,18446744073709551616", '"line\nend",7', "extra,5,x,y,z", "  spaced , 8 ", "b\"are,9", "back\\slash,3", "a/" * 500 + "file.txt,1", "tier,4,GLACIER",
]
WANT = {
    "abc/def.txt": 0, "abc/e.txt": 0, "日本語/ファイル.txt": 100, 'file with "quotes".txt': 100, "file,with,commas.txt": 100, "folder/": 0, "neg": 0, "plus": 0, "dot": 0,
    "big": 0, "line\nend": 7, "extra": 5, "  spaced ": 8, 'b"are': 9, "back\\slash": 3, "a/" * 500 + "file.txt": 1, "tier": 4,
}


@pytest.mark.parametrize("zipped", [False, True])
def test_csv_rules(spark, tmp_path, zipped):
    path = tmp_path / ("x.csv.gz" if zipped else "x.csv")
    data = "\n".join(RAW).encode()
    path.write_bytes(gzip.compress(data) if zipped else data)
    got = inventory.scan_csv(spark, [str(path)], {"key": 0, "size": 1, "storage_class": 2}, 3).collect()
    assert {r["key"]: r["size"] for r in got} == WANT and len(got) == len(WANT)
    assert {r["key"]: r["storage_class"] for r in got}["tier"] == "GLACIER"


def test_csv_header(spark, tmp_path):
    (tmp_path / "h.csv").write_text("BUCKET,  Key  ,SIZE,StorageClass\nb,a/1,5,GLACIER\nb,a/2,x,\n")
    rows = inventory.read_csv_with_header(spark, [str(tmp_path / "h.csv")])
    assert [(r["key"], r["size"], r["storage_class"]) for r in rows.orderBy("key").collect()] == [("a/1", 5, "GLACIER"), ("a/2", 0, "")]
    assert inventory.read_csv_with_header(spark, [str(tmp_path / "h.csv")], track_tiers=False).where("storage_class <> ''").count() == 0
    for head in ("bucket,size", "key,bytes"):
        (tmp_path / "bad.csv").write_text(f"{head}\n1,2\n")
        with pytest.raises(mf.ManifestError):
            inventory.read_csv_with_header(spark, [str(tmp_path / "bad.csv")])


ROWS = [("data/file1.txt", 100, "STANDARD"), ("data/file2.txt", 200, "GLACIER"), ("data/subfolder/file3.txt", 300, "STANDARD_IA"), ("archive/old.zip", 1000, "DEEP_ARCHIVE")]


def test_csv_equals_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"bk,{k},{s},{c}\n" for k, s, c in ROWS))
    spark.createDataFrame(ROWS, "key string, size bigint, storage_class string").write.parquet(str(tmp_path / "a.parquet"))
    csv = inventory.read_inventory(spark, mf.parse_manifest(text(fileSchema="Bucket,Key,Size,StorageClass", files=[{"key": "a.csv"}])), str(tmp_path))
    parquet = inventory.read_inventory(spark, mf.parse_manifest(text(fileFormat="Parquet", files=[{"key": "a.parquet"}])), str(tmp_path))
    assert csv.orderBy("key").collect() == parquet.orderBy("key").collect()


def test_parquet_rules(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("a", None), (None, 5), ("", 6), ("b", 7)], "key string, size bigint").write.parquet(path)
    assert [tuple(r) for r in inventory.read_parquet(spark, [path]).orderBy("key").collect()] == [("a", 0, "", ""), ("b", 7, "", "")]
    spark.createDataFrame([("a", -1)], "key string, size bigint").write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="negative size of a"):
        inventory.read_parquet(spark, [path]).collect()
    spark.createDataFrame([("a", 1)], "Key string, size bigint").write.mode("overwrite").parquet(path)
    with pytest.raises(mf.ManifestError):
        inventory.read_parquet(spark, [path])


def make_inventory(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "1.csv.gz").write_bytes(gzip.compress("".join(f"bk,{k},{s},{c},\n" for k, s, c in ROWS).encode()))
    (tmp_path / "manifest.json").write_text(text())
    return str(tmp_path / "manifest.json")


@pytest.mark.parametrize("partition", [False, True])
def test_store(spark, tmp_path, partition):
    nodes = build_nodes(objects(spark, 500), tiers=True)
    out = str(tmp_path / "index")
    written = write_index(nodes, out, partition=partition)
    index = Index.open(spark, out)
    assert verify(spark, out) == []
    assert (index.count, index.max_depth) == (nodes.count(), written["max_depth"]) and index.has_tiers
    assert index.nodes.orderBy("pos").collect() == nodes.select(*index.nodes.columns).orderBy("pos").collect()
    assert index.stats("") == (500, sum((i % 1000 + 1) * 100 for i in range(500)))
    assert index.stats("nope/") is None and index.prefix(0) == ""
    part = next((tmp_path / "index" / "nodes").rglob("*.parquet"))
    part.with_name(f".{part.name}.crc").unlink()  # the file system's own check
    part.write_bytes(part.read_bytes() + b"x")
    assert any("changed" in x for x in verify(spark, out))


def test_store_errors(spark, tmp_path):
    with pytest.raises(StoreError):
        Index.open(spark, str(tmp_path / "nothing"))
    write_index(build_nodes(objects(spark, 0), tiers=True), str(tmp_path / "empty"))
    index = Index.open(spark, str(tmp_path / "empty"))
    assert index.count == 0 and not index.has_tiers and index.stats("") is None


def test_build_and_command_line(spark, tmp_path, capsys):
    manifest = make_inventory(tmp_path)
    out = str(tmp_path / "index")
    cli.run(["build", "--out", out, "--s3-manifest", manifest, "--root", str(tmp_path)], spark)
    cli.run(["query", "--index", out, "--prefix", "data/", "--show-tiers", "--estimate-cost"], spark)
    shown = capsys.readouterr().out.splitlines()
    assert shown[:3] == ["Prefix: data/", "Objects: 3", "Bytes: 600"]
    assert shown[4:8] == ["Tier breakdown:", "  STANDARD: 1 objects, 100 bytes", "  STANDARD_IA: 1 objects, 300 bytes", "  GLACIER: 1 objects, 200 bytes"]
    assert shown[9] == "Estimated monthly cost:" and shown[10].startswith("  Total: $0.0000") and [x.split(":")[0] for x in shown[11:]] == ["  GLACIER", "  STANDARD", "  STANDARD_IA"]
    with pytest.raises(LookupError, match="prefix not found: data"):
        cli.run(["query", "--index", out, "--prefix", "data"], spark)
    done = build_index(spark, manifest, str(tmp_path / "capped"), root=str(tmp_path), max_depth=1)
    assert (done.files, done.objects, done.prefixes, done.max_depth) == (1, 4, 3, 1)


@pytest.mark.parametrize("args", [[], ["nope"], ["build"], ["build", "--out", "x"], ["query"], ["query", "--index", "x"], ["query", "--bogus"]])
def test_usage(args):
    with pytest.raises(cli.UsageError):
        cli.run(args)


def test_budget(monkeypatch):
    monkeypatch.setenv("ARBORLAKE_MEMORY", "2GiB")
    assert MemoryBudget.determine("4GiB").total == 4 << 30
    assert MemoryBudget.determine().source == "environment"
    monkeypatch.delenv("ARBORLAKE_MEMORY")
    half = MemoryBudget.determine()
    assert half.source.startswith("half") and half.share("aggregation") == half.total // 2
    assert half.spark_conf(3)["spark.master"] == "local[3]"


@pytest.mark.parametrize("shape", SHAPES)
def test_synthetic_shapes(spark, shape):
    made = objects(spark, 60, shape)
    assert made.count() == 60 and made.select("key").distinct().count() == 60
    depth = nav.summary(build_nodes(made)).first()["max_depth"]
    assert depth == {"deep_narrow": 20, "wide_shallow": 1, "balanced": 3, "realistic": 5, "wide_single_level": 2}[shape]


def test_stream(spark, tmp_path):
    rows = [(f"a/{i % 3}/{i}", i) for i in range(20)]
    folder, table, check = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for half in (rows[:10], rows[10:]):
        spark.createDataFrame(half, "key string, size bigint").coalesce(1).write.mode("append").parquet(folder)
        start_rollup_table(read_object_stream(spark, folder, 1), table, check).awaitTermination()
    want = rollup(spark.createDataFrame(rows, "key string, size bigint"))
    assert current_rollup(spark, table).orderBy("prefix").collect() == want.orderBy("prefix").collect()
