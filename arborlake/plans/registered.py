"""The registered queries over inventories that are derived from the driver's tables, and their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.prefixes import parent_dir, prefix_array
from arborlake.functions.sizes import size_expr
from arborlake.functions.tiers import tier_id, tier_name
from arborlake.operators import navigation as nav
from arborlake.operators import pricing
from arborlake.operators import tier_breakdown as tb
from arborlake.operators.numbering import number_nodes, shared_folder
from arborlake.operators.rollup import merge_rollups, prefix_rows, rollup, rollup_direct, rollup_tiers_long
from arborlake.plans.build import build_index
from arborlake.sources.inventory import read_csv_with_header, read_inventory, with_tiers
from arborlake.sources.manifest import fetch_manifest, file_paths
from arborlake.sources.store import Index, put_text, verify

Query = Callable[[SparkSession, str], DataFrame]

#: Classes and access tiers of the derived inventory, as text columns of any spelling.
CLASSES = ["STANDARD", "standard_ia", " ONEZONE_IA ", "GLACIER_IR", "GLACIER", "DEEP_ARCHIVE", "REDUCED_REDUNDANCY", "INTELLIGENT_TIERING", "UNKNOWN_CLASS"]
ACCESS = ["", "FREQUENT_ACCESS", "INFREQUENT", "ARCHIVE_INSTANT_ACCESS", "ARCHIVE", "DEEP_ARCHIVE_ACCESS", "bogus"]
SIZE_TOKENS = ["12", " 7 ", "", "abc", "-5", "+5", "5.0", "007", "18446744073709551616", "99999999999999999999999", "9223372036854775807", "1e3", "0"]
#: The prefix that single look-ups go to, and one that isn't there.
PREFIX, MISS = "A/F/", "A/F"


def lineitem_inventory(spark: SparkSession, sf_dir: str, unit: int = 4096) -> DataFrame:
    """One object per line item: (key, size, storage_class, access_tier)."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.concat(F.lit("o"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"), F.lit(".bin"))
    key = F.concat_ws("/", "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy"), F.date_format("l_shipdate", "MM"), name)
    of = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    return t.select(key.alias("key"), (F.col("l_quantity").cast("bigint") * unit).alias("size"), of(CLASSES, F.col("l_partkey")).alias("storage_class"), of(ACCESS, F.col("l_suppkey")).alias("access_tier"))


def lineitem_objects(spark: SparkSession, sf_dir: str, unit: int = 4096) -> DataFrame:
    rows = lineitem_inventory(spark, sf_dir, unit)
    return rows.select("key", "size", tier_id(F.col("storage_class"), F.col("access_tier")).alias("tier_id"))


def document_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.concat_ws("/", "lang", "source", F.concat(F.lit("d"), F.col("doc_id"), F.lit(".txt")))
    return t.select(key.alias("key"), F.col("n_chars").alias("size"))


def event_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.concat_ws("/", "event_type", F.date_format("ts", "yyyy/MM/dd"), F.concat(F.lit("u"), F.col("user_id")), F.concat(F.lit("e"), F.col("event_id"), F.lit(".json")))
    return t.select(key.alias("key"), F.floor(F.col("value") * 100).cast("bigint").alias("size"))


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return t.select(F.col("url").alias("key"), F.length("html").cast("bigint").alias("size"))


def _rolled(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return rollup(lineitem_objects(spark, sf_dir), **how)


#: Stored indexes by application and tables: walks ask the index, which is built once.
_BUILT: dict[tuple[str, str], Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the line items, built from a manifest and its listings at first use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        out = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        folder, manifest = _listing(spark, sf_dir, "parquet")
        build_index(spark, manifest, out, root=folder)
        _BUILT[key] = Index.open(spark, out)
    found = _BUILT[key]
    return Index(spark.read.schema(found.nodes.schema).parquet(f"{found.path}/nodes"), found.manifest, found.tiers, found.path)


def _with_nodes(walk: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: walk(_index(spark, sf_dir).nodes)


#: Records of a listing that only a right reading gets right: a comma and a quote in a key, sizes that are none
#: or beyond 63 bits, an empty key, a record without a size.
ODD_RECORDS = ['b,"odd/a,b.txt",5,GLACIER,', 'b,"odd/q""x.txt",abc,,', "b,,7,STANDARD,", "b,odd/short", "b,odd/big.txt,18446744073709551615,STANDARD,"]
FILE_SCHEMA = "Bucket, Key, Size, StorageClass, IntelligentTieringAccessTier"


def _listing(spark: SparkSession, sf_dir: str, kind: str) -> tuple[str, str]:
    """The inventory written as listings (csv, header, gzip or parquet); their folder and manifest."""
    folder = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    rows = lineitem_inventory(spark, sf_dir)
    if kind == "parquet":
        rows.select("key", "size", "storage_class", F.col("access_tier").alias("intelligent_tiering_access_tier")).write.parquet(f"{folder}/data")
    else:
        text = rows.select(F.lit("b").alias("Bucket"), F.col("key").alias("Key"), F.col("size").alias("Size"), F.col("storage_class").alias("StorageClass"), F.col("access_tier").alias("IntelligentTieringAccessTier"))
        options = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "header": str(kind == "header").lower(), "compression": "gzip" if kind == "gzip" else "none"}
        text.repartition(4).write.options(**options).csv(f"{folder}/data")
        first = [",".join(text.columns)] if kind == "header" else []
        if kind != "gzip":
            odd = spark.range(1).select(F.explode(F.array(*map(F.lit, [*first, *ODD_RECORDS]))).alias("value"))
            odd.coalesce(1).write.mode("append").text(f"{folder}/odd")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
    files = [f.split(folder.split(":", 1)[-1], 1)[1].lstrip("/") for f in reader.text(folder).inputFiles()]
    manifest = {"sourceBucket": "b", "destinationBucket": "arn:aws:s3:::inventory", "fileFormat": "Parquet" if kind == "parquet" else "CSV", "fileSchema": FILE_SCHEMA, "files": [{"key": f, "size": 0} for f in files]}
    put_text(spark, f"{folder}/manifest.json", json.dumps(manifest))
    return folder, f"{folder}/manifest.json"


def _scanned(kind: str) -> Query:
    def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, path = _listing(spark, sf_dir, kind)
        manifest = fetch_manifest(spark, path)
        if kind == "header":
            return read_csv_with_header(spark, file_paths(manifest, folder))
        return read_inventory(spark, manifest, folder)

    return scan


def index_breakdown(spark, sf_dir):
    rows = _index(spark, sf_dir).breakdown(PREFIX)
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"tier_name": t, "object_count": n, "bytes": b} for t, n, b in rows])), F.lit("array<struct<tier_name:string,object_count:bigint,bytes:bigint>>"))))


def index_manifest(spark, sf_dir):
    index = _index(spark, sf_dir)
    wrong = F.lit(len(verify(spark, index.path))).cast("bigint")
    return spark.range(1).select(F.lit(index.count).cast("bigint").alias("node_count"), F.lit(index.max_depth).alias("max_depth"), F.lit(len(index.tiers)).cast("bigint").alias("tiers"), wrong.alias("changed_files"))


def _tiers(spark: SparkSession, sf_dir: str, unit: int = 4096) -> DataFrame:
    return rollup(lineitem_objects(spark, sf_dir, unit), tiers=True)


def _slim(nodes: DataFrame) -> DataFrame:
    return nodes.select("prefix", "depth", "pos", "object_count", "total_bytes")


def prefix_extract(spark, sf_dir):
    return prefix_rows(lineitem_objects(spark, sf_dir))


def prefix_extract_max_depth(spark, sf_dir):
    return prefix_rows(lineitem_objects(spark, sf_dir), 2)


def partial_merge(spark, sf_dir):
    objects = lineitem_objects(spark, sf_dir)
    half = F.pmod(F.xxhash64("key"), F.lit(2)) == 0
    return merge_rollups(rollup(objects.where(half)), rollup(objects.where(~half)))


def tier_mapping(spark, sf_dir):
    rows = lineitem_inventory(spark, sf_dir).groupBy("storage_class", "access_tier").agg(F.count("*").alias("n"))
    tid = tier_id(F.col("storage_class"), F.col("access_tier"))
    return rows.select("storage_class", "access_tier", tid.alias("tier_id"), tier_name(tid).alias("tier_name"), "n")


def lookup_batch(spark, sf_dir):
    nodes = _index(spark, sf_dir).nodes
    asked = lineitem_objects(spark, sf_dir).select(parent_dir(F.col("key"), 3).alias("prefix"))
    return _slim(nav.lookup_many(nodes, asked))


def tier_breakdown_map(spark, sf_dir):
    maps = tb.breakdown_map(_tiers(spark, sf_dir))
    entries = F.array_sort(F.transform(F.map_entries("tiers"), lambda e: F.concat_ws(":", e["key"], e["value"]["object_count"], e["value"]["bytes"])))
    return maps.select("prefix", F.array_join(entries, ";").alias("tiers"))


def size_parse(spark, sf_dir):
    tokens = spark.range(1).select(F.explode(F.array(*map(F.lit, SIZE_TOKENS))).alias("token"))
    return tokens.select("token", size_expr(F.col("token")).alias("size"))


QUERIES: dict[str, Query] = {
    "prefix_extract": prefix_extract,
    "prefix_extract_max_depth": prefix_extract_max_depth,
    "rollup_stats": lambda s, d: rollup_direct(lineitem_objects(s, d)),
    "rollup_stats_max_depth": lambda s, d: _rolled(s, d, max_depth=2),
    "rollup_preagg": lambda s, d: _rolled(s, d),
    "rollup_tiers_wide": lambda s, d: _rolled(s, d, tiers=True),
    "rollup_tiers_long": lambda s, d: rollup_tiers_long(lineitem_objects(s, d)),
    "tier_mapping": tier_mapping,
    "partial_merge": partial_merge,
    "preorder_nodes": lambda s, d: number_nodes(_rolled(s, d)),
    "preorder_nodes_ranges": lambda s, d: number_nodes(_rolled(s, d), 4),
    "broken_ranges": _with_nodes(lambda n: nav.broken_ranges(n).select("prefix", "pos")),
    "index_summary": _with_nodes(nav.summary),
    "present_tiers": _with_nodes(tb.present_tiers),
    "lookup_hit": _with_nodes(lambda n: _slim(nav.lookup(n, PREFIX))),
    "lookup_miss": _with_nodes(lambda n: _slim(nav.lookup(n, MISS))),
    "lookup_root": _with_nodes(lambda n: _slim(nav.lookup(n, ""))),
    "lookup_batch": lookup_batch,
    "pos_to_prefix": _with_nodes(lambda n: nav.at_position(n, 7).select("pos", "prefix")),
    "children": _with_nodes(lambda n: _slim(nav.descendants_at(n, PREFIX, 1))),
    "self_at_depth0": _with_nodes(lambda n: _slim(nav.descendants_at(n, PREFIX, 0))),
    "descendants_depth2": _with_nodes(lambda n: _slim(nav.descendants_at(n, PREFIX, 2))),
    "descendants_up_to": _with_nodes(lambda n: nav.descendants_up_to(n, "A/", 2).select("prefix", "depth", "rel_depth", "object_count")),
    "descendants_all": _with_nodes(lambda n: _slim(nav.all_descendants(n, PREFIX))),
    "nodes_at_depth": _with_nodes(lambda n: _slim(nav.at_depth(n, 3))),
    "children_min_count": _with_nodes(lambda n: _slim(nav.descendants_at(n, "", 3, min_count=1440))),
    "children_min_bytes": _with_nodes(lambda n: _slim(nav.descendants_at(n, "", 3, min_bytes=150_000_000))),
    "children_min_both": _with_nodes(lambda n: _slim(nav.descendants_at(n, "", 3, min_count=1440, min_bytes=150_000_000))),
    "largest_prefixes": _with_nodes(lambda n: _slim(nav.largest(n, 10, depth=4))),
    "tier_breakdown": lambda s, d: tb.breakdown(_tiers(s, d)),
    "tier_breakdown_all": lambda s, d: (lambda n: tb.breakdown_present(n, nav.lookup(n, PREFIX)))(_index(s, d).nodes),
    "tier_breakdown_map": tier_breakdown_map,
    "cost_monthly": lambda s, d: pricing.cost_by_prefix(tb.breakdown(nav.lookup(_index(s, d).nodes, ""))),
    "cost_per_tier": lambda s, d: pricing.cost_per_tier(tb.breakdown(nav.lookup(_index(s, d).nodes, PREFIX))),
    "cost_detailed": lambda s, d: pricing.cost_detailed(tb.breakdown(nav.lookup(_index(s, d).nodes, ""))),
    "cost_all_prefixes": lambda s, d: pricing.cost_by_prefix(tb.breakdown(_tiers(s, d))),
    "cost_large_objects": lambda s, d: pricing.cost_by_prefix(tb.breakdown(_tiers(s, d, 65536))),
    "size_parse": size_parse,
    "source_csv": _scanned("csv"),
    "source_csv_header": _scanned("header"),
    "source_csv_gzip": _scanned("gzip"),
    "source_parquet": _scanned("parquet"),
    "source_objects": lambda s, d: with_tiers(_scanned("csv")(s, d)),
    "index_nodes": _with_nodes(lambda n: n.select("prefix", "depth", "pos", "subtree_end", "max_depth_in_subtree", "object_count", "total_bytes")),
    "index_tiers": _with_nodes(tb.breakdown),
    "index_prefixes": lambda s, d: _index(s, d).prefixes(),
    "index_children": lambda s, d: _slim(_index(s, d).descendants(PREFIX, 1)),
    "index_descendants": lambda s, d: _index(s, d).descendants_up_to("A/", 2).select("prefix", "depth", "rel_depth", "object_count"),
    "index_breakdown": index_breakdown,
    "index_manifest": index_manifest,
    "documents_tree": lambda s, d: rollup(document_objects(s, d)),
    "events_tree": lambda s, d: rollup(event_objects(s, d)),
    "url_tree": lambda s, d: rollup(page_objects(s, d)),
}


# The same in DuckDB's SQL. Common parts come first, then one statement per query.
def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _inventory(unit: int = 4096) -> str:
    return f"""inv as (select l_returnflag || '/' || l_linestatus || '/' || strftime(l_shipdate, '%Y/%m') || '/o' || l_orderkey || '-' || l_linenumber || '.bin' as key,
      cast(l_quantity as bigint) * {unit} as size, {_sql_list(CLASSES)}[l_partkey % {len(CLASSES)} + 1] as storage_class, {_sql_list(ACCESS)}[l_suppkey % {len(ACCESS)} + 1] as access_tier from lineitem)"""


_TIER = """case upper(trim(storage_class)) when 'STANDARD_IA' then 1 when 'ONEZONE_IA' then 2 when 'GLACIER_IR' then 3 when 'GLACIER' then 4 when 'DEEP_ARCHIVE' then 5
  when 'REDUCED_REDUNDANCY' then 6 when 'INTELLIGENT_TIERING' then case when access_tier in ('INFREQUENT_ACCESS', 'INFREQUENT') then 8 when access_tier = 'ARCHIVE_INSTANT_ACCESS' then 9
  when access_tier in ('ARCHIVE_ACCESS', 'ARCHIVE') then 10 when access_tier in ('DEEP_ARCHIVE_ACCESS', 'DEEP_ARCHIVE') then 11 else 7 end else 0 end"""
_NAMES = "['STANDARD','STANDARD_IA','ONEZONE_IA','GLACIER_IR','GLACIER','DEEP_ARCHIVE','REDUCED_REDUNDANCY','INTELLIGENT_TIERING_FREQUENT','INTELLIGENT_TIERING_INFREQUENT','INTELLIGENT_TIERING_ARCHIVE_INSTANT','INTELLIGENT_TIERING_ARCHIVE','INTELLIGENT_TIERING_DEEP_ARCHIVE']"


def _exploded(source: str, cap: int = 0, extra: str = "") -> str:
    top = f"least(len(string_split(key, '/')) - 1, {cap})" if cap else "len(string_split(key, '/')) - 1"
    return f"""e as (select key, size{extra}, d as depth, case when d = 0 then '' else array_to_string(list_slice(string_split(key, '/'), 1, d), '/') || '/' end as prefix
      from (select *, unnest(range(0, {top} + 1)) as d from {source}))"""


_SUMS = "cast(count(*) as bigint) as object_count, cast(sum(size) as bigint) as total_bytes"
_ROLL = f"n as (select prefix, cast(depth as int) as depth, {_SUMS} from e group by all)"
_TREE = f"with {_inventory()}, {_exploded('inv')}, {_ROLL}, p as (select *, row_number() over (order by prefix) - 1 as pos from n)"
_SLIM = "select prefix, depth, cast(pos as bigint) as pos, object_count, total_bytes from p"
_LONG = """t as (select *, {tier} as tier_id from inv), {exploded},
  b as (select prefix, cast(depth as int) as depth, cast(tier_id as int) as tier_id, {names}[tier_id + 1] as tier_name, cast(count(*) as bigint) as object_count, cast(sum(size) as bigint) as bytes from e group by all)"""


def _breakdown(unit: int = 4096) -> str:
    return f"with {_inventory(unit)}, " + _LONG.format(tier=_TIER, exploded=_exploded("t", 0, ", tier_id"), names=_NAMES)


_PRICES = ", ".join(f"('{k}', {v}::double)" for k, v in pricing.PER_GB_MONTH.items())


def _in(names) -> str:
    return "tier_name in (" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"


def _cost(unit: int = 4096) -> str:
    gb = "1073741824.0::double"
    return f"""{_breakdown(unit)}, pr(tier_name, price) as (values {_PRICES}),
  a as (select b.*, price, case when object_count > 0 then bytes // object_count else 0 end as av from b join pr using (tier_name)),
  c as (select *, bytes::double / {gb} * price as storage_d,
    case when {_in(pricing.MIN_SIZE_TIERS)} and av > 0 and av < 131072 then ((131072 - av) * object_count)::double / {gb} * price else 0.0::double end as min_d,
    (case when not ({_in(pricing.MONITORED_TIERS)}) then 0 when av >= 131072 then object_count when av > 0 then object_count // 2 else 0 end)::double / 1000.0::double * 0.0025::double as mon_d,
    case when {_in(pricing.ARCHIVE_TIERS)} then (object_count * 32768)::double / {gb} * price else 0.0::double end as arc_d,
    case when {_in(pricing.ARCHIVE_TIERS)} then (object_count * 8192)::double / {gb} * 0.023::double else 0.0::double end as idx_d from a),
  m as (select *, cast(floor(storage_d * 1e6::double) as bigint) as storage, cast(floor(min_d * 1e6::double) as bigint) as min_size, cast(floor(mon_d * 1e6::double) as bigint) as monitoring,
    cast(floor(arc_d * 1e6::double) as bigint) + cast(floor(idx_d * 1e6::double) as bigint) as archive from c)"""


_TOTAL = "select prefix, cast(sum(storage + min_size + archive + monitoring) as bigint) as total, cast(sum(min_size) as bigint) as min_size, cast(sum(monitoring) as bigint) as monitoring, cast(sum(archive) as bigint) as archive from m"
_DOCS = "inv as (select lang || '/' || source || '/d' || doc_id || '.txt' as key, n_chars as size from documents)"
_EVENTS = "inv as (select event_type || '/' || strftime(ts, '%Y/%m/%d') || '/u' || user_id || '/e' || event_id || '.json' as key, cast(floor(value * 100) as bigint) as size from events)"
_PAGES = "inv as (select url as key, cast(length(html) as bigint) as size from pages)"


def _tree_of(inventory: str) -> str:
    return f"with {inventory}, {_exploded('inv')}, {_ROLL} select * from n"


_WIDE = ", ".join([f"cast(count(*) filter (tier_id = {i}) as bigint) as t{i}_count" for i in range(12)] + [f"cast(coalesce(sum(size) filter (tier_id = {i}), 0) as bigint) as t{i}_bytes" for i in range(12)])
_FULL = f"{_TREE} select p.prefix, p.depth, cast(p.pos as bigint) as pos, cast(max(c.pos) as bigint) as subtree_end, max(c.depth) as max_depth_in_subtree, p.object_count, p.total_bytes from p join p c on starts_with(c.prefix, p.prefix) group by all"
_TOKENS = "select unnest([" + ", ".join(f"'{t}'" for t in SIZE_TOKENS) + "]) as token"

_SCANNED = f"with {_inventory()} select key, cast(size as bigint) as size, storage_class, access_tier from inv"
_SCANNED_ODD = f"{_SCANNED} union all select * from (values ('odd/a,b.txt', 5, 'GLACIER', ''), ('odd/q\"x.txt', 0, '', ''), ('odd/big.txt', 9223372036854775807, 'STANDARD', ''))"

ORACLES: dict[str, str] = {
    "prefix_extract": f"with {_inventory()}, {_exploded('inv')} select key, cast(depth as int) as depth, prefix from e",
    "prefix_extract_max_depth": f"with {_inventory()}, {_exploded('inv', 2)} select key, cast(depth as int) as depth, prefix from e",
    "rollup_stats": _tree_of(_inventory()),
    "rollup_stats_max_depth": f"with {_inventory()}, {_exploded('inv', 2)}, {_ROLL} select * from n",
    "rollup_preagg": _tree_of(_inventory()),
    "rollup_tiers_wide": f"with {_inventory()}, t as (select *, {_TIER} as tier_id from inv), {_exploded('t', 0, ', tier_id')} select prefix, cast(depth as int) as depth, {_SUMS}, {_WIDE} from e group by prefix, depth",
    "rollup_tiers_long": f"{_breakdown()} select prefix, depth, tier_id, object_count, bytes as total_bytes from b",
    "tier_mapping": f"with {_inventory()} select storage_class, access_tier, cast({_TIER} as int) as tier_id, {_NAMES}[{_TIER} + 1] as tier_name, cast(count(*) as bigint) as n from inv group by all",
    "partial_merge": _tree_of(_inventory()),
    "preorder_nodes": _FULL,
    "preorder_nodes_ranges": _FULL,
    "broken_ranges": f"{_TREE} select prefix, cast(pos as bigint) as pos from p where false",
    "index_summary": f"{_TREE} select cast(count(*) as bigint) as node_count, max(depth) as max_depth, cast(sum(object_count) filter (depth = 0) as bigint) as object_count, cast(sum(total_bytes) filter (depth = 0) as bigint) as total_bytes from p",
    "present_tiers": f"{_breakdown()} select distinct tier_id, tier_name from b",
    "lookup_hit": f"{_TREE} {_SLIM} where prefix = '{PREFIX}'",
    "lookup_miss": f"{_TREE} {_SLIM} where prefix = '{MISS}'",
    "lookup_root": f"{_TREE} {_SLIM} where prefix = ''",
    "lookup_batch": f"{_TREE} {_SLIM} where depth = 3",
    "pos_to_prefix": f"{_TREE} select cast(pos as bigint) as pos, prefix from p where pos = 7",
    "children": f"{_TREE} {_SLIM} where depth = 3 and starts_with(prefix, '{PREFIX}')",
    "self_at_depth0": f"{_TREE} {_SLIM} where prefix = '{PREFIX}'",
    "descendants_depth2": f"{_TREE} {_SLIM} where depth = 4 and starts_with(prefix, '{PREFIX}')",
    "descendants_up_to": f"{_TREE} select prefix, depth, depth - 1 as rel_depth, object_count from p where depth between 2 and 3 and starts_with(prefix, 'A/')",
    "descendants_all": f"{_TREE} {_SLIM} where prefix <> '{PREFIX}' and starts_with(prefix, '{PREFIX}')",
    "nodes_at_depth": f"{_TREE} {_SLIM} where depth = 3",
    "children_min_count": f"{_TREE} {_SLIM} where depth = 3 and object_count >= 1440",
    "children_min_bytes": f"{_TREE} {_SLIM} where depth = 3 and total_bytes >= 150000000",
    "children_min_both": f"{_TREE} {_SLIM} where depth = 3 and object_count >= 1440 and total_bytes >= 150000000",
    "largest_prefixes": f"{_TREE} {_SLIM} where depth = 4 order by total_bytes desc, prefix limit 10",
    "tier_breakdown": f"{_breakdown()} select prefix, tier_id, tier_name, object_count, bytes from b",
    "tier_breakdown_all": f"{_breakdown()}, r as (select distinct tier_id, tier_name from b) select '{PREFIX}' as prefix, r.tier_id, r.tier_name, coalesce(object_count, 0) as object_count, coalesce(bytes, 0) as bytes from r left join (select * from b where prefix = '{PREFIX}') b using (tier_id)",
    "tier_breakdown_map": f"{_breakdown()} select prefix, array_to_string(list_sort(list(tier_name || ':' || object_count || ':' || bytes)), ';') as tiers from b group by prefix",
    "cost_monthly": f"{_cost()} {_TOTAL} where prefix = '' group by prefix",
    "cost_per_tier": f"{_cost()} select prefix, tier_name, storage + min_size + archive as micro_dollars, storage, min_size, monitoring, archive from m where prefix = '{PREFIX}'",
    "cost_detailed": f"{_cost()} select prefix, tier_name, object_count, bytes, storage_d as storage, min_d as min_size, mon_d as monitoring, arc_d + idx_d as archive, storage_d + min_d + mon_d + (arc_d + idx_d) as total from m where prefix = ''",
    "cost_all_prefixes": f"{_cost()} {_TOTAL} group by prefix",
    "cost_large_objects": f"{_cost(65536)} {_TOTAL} group by prefix",
    "size_parse": f"select token, case when regexp_full_match(trim(token), '[0-9]+') and coalesce(try_cast(trim(token) as hugeint), 18446744073709551616::hugeint) <= 18446744073709551615::hugeint then cast(least(try_cast(trim(token) as hugeint), 9223372036854775807::hugeint) as bigint) else 0 end as size from ({_TOKENS})",
    "source_csv": _SCANNED_ODD,
    "source_csv_header": _SCANNED_ODD,
    "source_csv_gzip": _SCANNED,
    "source_parquet": _SCANNED,
    "source_objects": f"with inv as ({_SCANNED_ODD}) select key, size, cast({_TIER} as int) as tier_id from inv",
    "index_nodes": _FULL,
    "index_tiers": f"{_breakdown()} select prefix, tier_id, tier_name, object_count, bytes from b",
    "index_prefixes": f"{_TREE} select cast(pos as bigint) as pos, prefix from p",
    "index_children": f"{_TREE} {_SLIM} where depth = 3 and starts_with(prefix, '{PREFIX}')",
    "index_descendants": f"{_TREE} select prefix, depth, depth - 1 as rel_depth, object_count from p where depth between 2 and 3 and starts_with(prefix, 'A/')",
    "index_breakdown": f"{_breakdown()} select tier_name, object_count, bytes from b where prefix = '{PREFIX}'",
    "index_manifest": f"{_breakdown()} select cast(count(distinct prefix) as bigint) as node_count, max(depth) as max_depth, cast(count(distinct tier_id) as bigint) as tiers, cast(0 as bigint) as changed_files from b",
    "documents_tree": _tree_of(_DOCS),
    "events_tree": _tree_of(_EVENTS),
    "url_tree": _tree_of(_PAGES),
}

__all__ = ["ORACLES", "QUERIES", "lineitem_objects", "prefix_array"]
