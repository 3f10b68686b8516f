"""Monthly storage cost of tier breakdowns.

Amounts are integer micro-dollars, cut (not rounded) after the same order of double operations in the
column form and in the plain form, so that both and any IEEE engine agree to the last digit.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars per GiB and month by tier.
PER_GB_MONTH = {
    "STANDARD": 0.023,
    "STANDARD_IA": 0.0125,
    "ONEZONE_IA": 0.01,
    "REDUCED_REDUNDANCY": 0.024,
    "GLACIER_IR": 0.004,
    "GLACIER": 0.0036,
    "DEEP_ARCHIVE": 0.00099,
    "INTELLIGENT_TIERING_FREQUENT": 0.023,
    "INTELLIGENT_TIERING_INFREQUENT": 0.0125,
    "INTELLIGENT_TIERING_ARCHIVE_INSTANT": 0.004,
    "INTELLIGENT_TIERING_ARCHIVE": 0.0036,
    "INTELLIGENT_TIERING_DEEP_ARCHIVE": 0.00099,
}
#: Dollars per 1000 monitored objects; the standard price of index entries.
MONITORING_PER_1000, STANDARD_PER_GB = 0.0025, 0.023
#: Tiers with a least billed size, with monitoring, with archive overhead.
MIN_SIZE_TIERS = frozenset({"STANDARD_IA", "ONEZONE_IA", "GLACIER_IR"})
MONITORED_TIERS = frozenset({"INTELLIGENT_TIERING_FREQUENT", "INTELLIGENT_TIERING_INFREQUENT", "INTELLIGENT_TIERING_ARCHIVE_INSTANT", "INTELLIGENT_TIERING_ARCHIVE", "INTELLIGENT_TIERING_DEEP_ARCHIVE"})
ARCHIVE_TIERS = frozenset({"GLACIER", "DEEP_ARCHIVE", "INTELLIGENT_TIERING_ARCHIVE", "INTELLIGENT_TIERING_DEEP_ARCHIVE"})
#: Fixed values in bytes: the billing unit, least billed size, overheads of an archived object.
GB, MIN_SIZE, ARCHIVE_OVERHEAD, INDEX_OVERHEAD = 1 << 30, 131072, 32768, 8192


@dataclass(frozen=True)
class PriceTable:
    per_gb_month: dict[str, float] = field(default_factory=lambda: dict(PER_GB_MONTH))
    monitoring_per_1000_objects: float = MONITORING_PER_1000
    standard_price_per_gb: float = STANDARD_PER_GB

    @classmethod
    def load(cls, path: str | os.PathLike) -> PriceTable:
        """From JSON with ``per_gb_month``, ``monitoring_per_1000_objects`` and ``standard_price_per_gb``.
        A table without ``per_gb_month`` would price everything at nothing, so it's an error."""
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        if not isinstance(raw, dict) or not isinstance(raw.get("per_gb_month"), dict):
            raise ValueError("a price table needs an object per_gb_month")
        return cls({k: float(v) for k, v in raw["per_gb_month"].items()}, float(raw.get("monitoring_per_1000_objects", 0)), float(raw.get("standard_price_per_gb", 0)))

    def save(self, path: str | os.PathLike) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"per_gb_month": self.per_gb_month, "monitoring_per_1000_objects": self.monitoring_per_1000_objects, "standard_price_per_gb": self.standard_price_per_gb}, f, indent=2)


@dataclass
class Cost:
    """Micro-dollars a month. ``per_tier`` holds storage and penalties, but not monitoring."""

    total: int = 0
    min_size: int = 0
    monitoring: int = 0
    archive: int = 0
    per_tier: dict[str, int] = field(default_factory=dict)

    @property
    def dollars(self) -> float:
        return self.total / 1e6

    @property
    def dollars_per_tier(self) -> dict[str, float]:
        return {k: v / 1e6 for k, v in self.per_tier.items()}


def _parts(tier: str, count: int, size: int, prices: PriceTable) -> dict[str, float]:
    """Dollars of one tier by part."""
    price = prices.per_gb_month[tier]
    avg = size // count if count > 0 else 0
    small = 0 < avg < MIN_SIZE
    seen = (count if avg >= MIN_SIZE else count // 2 if small else 0) if tier in MONITORED_TIERS and prices.monitoring_per_1000_objects > 0 else 0
    held = tier in ARCHIVE_TIERS and count > 0
    return {
        "storage": size / GB * price,
        "min_size": (MIN_SIZE - avg) * count / GB * price if tier in MIN_SIZE_TIERS and small else 0.0,
        "monitoring": seen / 1000.0 * prices.monitoring_per_1000_objects,
        "archive": count * ARCHIVE_OVERHEAD / GB * price if held else 0.0,
        "index": count * INDEX_OVERHEAD / GB * prices.standard_price_per_gb if held else 0.0,
    }


def monthly_cost(tiers: list[tuple[str, int, int]], prices: PriceTable | None = None) -> Cost:
    """Cost of (tier name, objects, bytes) rows; tiers without a price are left out."""
    prices = prices or PriceTable()
    out = Cost()
    for tier, count, size in tiers:
        if tier not in prices.per_gb_month:
            continue
        micro = {k: int(v * 1e6) for k, v in _parts(tier, count, size, prices).items()}
        archive = micro["archive"] + micro["index"]
        own = micro["storage"] + micro["min_size"] + archive
        out.per_tier[tier] = out.per_tier.get(tier, 0) + own
        out.min_size += micro["min_size"]
        out.monitoring += micro["monitoring"]
        out.archive += archive
        out.total += own + micro["monitoring"]
    return out


def _by_tier(values: dict[str, float], kind: str = "double") -> Column:
    out = F.lit(None).cast(kind)
    for tier, v in values.items():
        out = F.when(F.col("tier_name") == tier, F.lit(v)).otherwise(out)
    return out


def _priced(tiers: DataFrame, prices: PriceTable) -> DataFrame:
    """Dollars by part for each row of a breakdown with a price."""
    count, size = F.col("object_count"), F.col("bytes")
    price, gb = F.col("price"), F.lit(float(GB))
    avg = F.when(count > 0, F.expr("bytes div object_count")).otherwise(F.lit(0).cast("long"))
    small = (F.col("avg") > 0) & (F.col("avg") < MIN_SIZE)
    monitored = F.col("tier_name").isin(*sorted(MONITORED_TIERS)) & F.lit(prices.monitoring_per_1000_objects > 0)
    held = F.col("tier_name").isin(*sorted(ARCHIVE_TIERS)) & (count > 0)
    seen = F.when(~monitored, F.lit(0).cast("long")).when(F.col("avg") >= MIN_SIZE, count).when(small, F.expr("object_count div 2")).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0.0)
    return (
        tiers.withColumn("price", _by_tier(prices.per_gb_month))
        .where(price.isNotNull())
        .withColumn("avg", avg)
        .withColumn("storage", size.cast("double") / gb * price)
        .withColumn("min_size", F.when(F.col("tier_name").isin(*sorted(MIN_SIZE_TIERS)) & small, ((F.lit(MIN_SIZE) - F.col("avg")) * count).cast("double") / gb * price).otherwise(zero))
        .withColumn("monitoring", seen.cast("double") / F.lit(1000.0) * F.lit(float(prices.monitoring_per_1000_objects)))
        .withColumn("archive", F.when(held, (count * ARCHIVE_OVERHEAD).cast("double") / gb * price).otherwise(zero))
        .withColumn("index_entries", F.when(held, (count * INDEX_OVERHEAD).cast("double") / gb * F.lit(float(prices.standard_price_per_gb))).otherwise(zero))
    )


def _micro(c: str) -> Column:
    return (F.col(c) * F.lit(1e6)).cast("long")


def cost_per_tier(tiers: DataFrame, prices: PriceTable | None = None) -> DataFrame:
    """(prefix, tier_name, micro_dollars, storage, min_size, monitoring, archive) in micro-dollars;
    ``micro_dollars`` is without monitoring."""
    priced = _priced(tiers, prices or PriceTable())
    archive = _micro("archive") + _micro("index_entries")
    own = _micro("storage") + _micro("min_size") + archive
    return priced.select("prefix", "tier_name", own.alias("micro_dollars"), _micro("storage").alias("storage"), _micro("min_size").alias("min_size"), _micro("monitoring").alias("monitoring"), archive.alias("archive"))


def cost_by_prefix(tiers: DataFrame, prices: PriceTable | None = None) -> DataFrame:
    """(prefix, total, min_size, monitoring, archive) in micro-dollars."""
    each = cost_per_tier(tiers, prices)
    return each.groupBy("prefix").agg(F.sum(F.col("micro_dollars") + F.col("monitoring")).alias("total"), F.sum("min_size").alias("min_size"), F.sum("monitoring").alias("monitoring"), F.sum("archive").alias("archive"))


def cost_detailed(tiers: DataFrame, prices: PriceTable | None = None) -> DataFrame:
    """Dollars as doubles by prefix and tier, uncut; here the total includes monitoring."""
    priced = _priced(tiers, prices or PriceTable())
    archive = F.col("archive") + F.col("index_entries")
    total = F.col("storage") + F.col("min_size") + F.col("monitoring") + archive
    return priced.select("prefix", "tier_name", "object_count", "bytes", "storage", "min_size", "monitoring", archive.alias("archive"), total.alias("total"))


def format_dollars(dollars: float) -> str:
    """With six, four, two or no decimals, as the amount is below 0.01, 1, 100 or above."""
    digits = 6 if dollars < 0.01 else 4 if dollars < 1 else 2 if dollars < 100 else 0
    return f"${dollars:.{digits}f}"


def format_cost(micro_dollars: int) -> str:
    return format_dollars(micro_dollars / 1e6)
