"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import decontaminate, html_extract, licenses, mixing, near_duplicates, prefix_tokens, quality, repair, sharding, toxicity
from arborlake.llm.common import written

SHARDS = 8


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine and, installed alike, on executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.toxicity_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shuffle_into_shards(docs, SHARDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]
    return out.select("doc_id", *digest, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repair.read_ids(repair.write_ids(docs, tokenizer_path("word_bpe_49k.json")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.quality_verdicts(docs, _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op7_mixing_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("detections")


def op9_probminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", "class_size", "n_links", "stays")


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = prefix_tokens.prefix_token_counts(docs, tokenizer_path("byte_bpe_50k.json"), budget=1024)
    counts = written(counts, "prefix-counts")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fit_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_cnn": op1_toxicity_cnn,
    "op2_hypergeometric_sharding": op2_hypergeometric_sharding,
    "op3_site_style_tree": op3_site_style_tree,
    "op4_repair_token_files": op4_repair_token_files,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing_flow": op7_mixing_flow,
    "op8_license_signatures": op8_license_signatures,
    "op9_probminhash_near_duplicates": op9_probminhash_near_duplicates,
    "op10_prefix_token_counts": op10_prefix_token_counts,
}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_BLANK = r"[\x20\x09-\x0D]"
_GRID = ", ".join(f"('{r}', {i}, {c}::double)" for r, (_, _, cs) in quality.RULES.items() for i, c in enumerate(cs))
_RULES = " union all ".join(f"select *, '{r}' as rule, {num} as num, {den} as den from h" for r, (num, den, _) in quality.RULES.items())
_FAILED = ", ".join(f"case when max(case when c.rule = '{r}' and {den} > 0 and {num} > c.cutoff * {den} then 1 end) = 1 then '{r}' end" for r, (num, den, _) in quality.RULES.items())

ORACLES: dict[str, str] = {
    "op6_quality_rules": f"""
with d as (select row_number() over () as rid, doc_id, case when lang in ('en', 'de', 'fr', 'es') then lang else 'other' end as stratum, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
g as (select rid, k, array_to_string(list_slice(ws, k, k + 2), ' ') as win from (select rid, ws, unnest(range(1, len(ws) - 1)) as k from w where len(ws) > 3)),
r as (select rid, count(distinct k + o) as n from (select rid, k from (select rid, k, count(*) over (partition by rid, win) as c from g) where c > 1), (select unnest([0, 1, 2]) as o) group by rid),
s as (select rid, doc_id, stratum, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '{_BLANK}', '', 'g')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
      cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words from w left join r using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
h as (select *, md5(cast(doc_id as varchar)) < '{quality.PROPOSING}' as proposes from b where not base_failed and doc_id in (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1)),
l as ({_RULES}),
grid(rule, step, cutoff) as (values {_GRID}), paths(j, share, back) as (values {", ".join(f"({j}, {x}::double, {back})" for j, (x, back) in enumerate(quality.PATH))}),
sel as (select stratum, rule, step, cutoff, count(*) as n, sum(case when den > 0 and num > cutoff * den then 1 else 0 end) as rej from l join grid using (rule) where proposes group by all),
most as (select stratum, j, back, rule, max(step) as step from sel, paths where rej <= floor(share * n) group by all),
cfg as (select stratum, j, m.rule, cutoff from most m join grid on grid.rule = m.rule and grid.step = m.step - back),
bad as (select l.stratum, paths.j, l.rid, max(case when den > 0 and num > c.cutoff * den then 1 else 0 end) as bad from l cross join paths left join cfg c on c.stratum = l.stratum and c.j = paths.j and c.rule = l.rule
        where not proposes and l.stratum in (select stratum from sel) group by all),
k as (select stratum, j, count(*) as n, sum(bad) as k from bad group by all),
p as (select *, case when k >= n * 0.03 then 1.0 else list_sum(list_transform(range(0, cast(k as bigint) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.03) + (n - i) * ln(0.97)))) end as p from k),
ok as (select stratum, max(j) as j from p x where not exists (select 1 from p y where y.stratum = x.stratum and y.j <= x.j and y.p > 0.05 / 5) group by stratum),
v as (select b.doc_id, b.rid, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, concat_ws(',', {_FAILED}) as failed_rules
      from b left join ok on ok.stratum = b.stratum left join cfg c on c.stratum = b.stratum and c.j = ok.j group by all)
select * exclude (rid), not base_failed and failed_rules = '' as kept from v""",
    "op5_benchmark_decontamination": f"""
with b as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as ws from benchmark),
w as (select distinct item, least(len(ws), 10) as n, array_to_string(list_slice(ws, k, k + 9), ' ') as win
      from (select item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as k from b where len(ws) > 0)),
d as (select row_number() over () as rid, doc_id, {_WORDS} as ws from documents),
g as (select rid, k, n, array_to_string(list_slice(ws, k, k + n - 1), ' ') as win
      from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d, (select distinct n from w) where len(ws) >= n)),
h as (select g.rid, g.k, g.n, w.item from g join w on g.win = w.win and g.n = w.n),
c as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(k, k + n)) as p from h) group by rid),
i as (select rid, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from h group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (rid) left join i using (rid)""",
}
