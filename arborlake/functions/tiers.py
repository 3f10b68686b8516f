"""The storage-tier dimension and the mapping from storage class and access tier."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tier(NamedTuple):
    tier_id: int
    tier_name: str
    column: str


#: Tier ids, names and short column names, in id order.
TIERS = (
    Tier(0, "STANDARD", "standard"),
    Tier(1, "STANDARD_IA", "standard_ia"),
    Tier(2, "ONEZONE_IA", "onezone_ia"),
    Tier(3, "GLACIER_IR", "glacier_ir"),
    Tier(4, "GLACIER", "glacier_fr"),
    Tier(5, "DEEP_ARCHIVE", "deep_archive"),
    Tier(6, "REDUCED_REDUNDANCY", "reduced_redundancy"),
    Tier(7, "INTELLIGENT_TIERING_FREQUENT", "it_frequent"),
    Tier(8, "INTELLIGENT_TIERING_INFREQUENT", "it_infrequent"),
    Tier(9, "INTELLIGENT_TIERING_ARCHIVE_INSTANT", "it_archive_instant"),
    Tier(10, "INTELLIGENT_TIERING_ARCHIVE", "it_archive"),
    Tier(11, "INTELLIGENT_TIERING_DEEP_ARCHIVE", "it_deep_archive"),
)
N_TIERS = len(TIERS)
#: Access tiers of the class INTELLIGENT_TIERING; any other one is tier 7.
ACCESS_TIERS = {
    8: ("INFREQUENT_ACCESS", "INFREQUENT"),
    9: ("ARCHIVE_INSTANT_ACCESS",),
    10: ("ARCHIVE_ACCESS", "ARCHIVE"),
    11: ("DEEP_ARCHIVE_ACCESS", "DEEP_ARCHIVE"),
}
UNKNOWN = "UNKNOWN"


def _clean(c: Column) -> Column:
    white = "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), f"^{white}|{white}$", ""))


def tier_id(storage_class: Column, access_tier: Column) -> Column:
    """Tier id of an object. White space around and case don't matter; an unknown or empty class is
    STANDARD, an unknown access tier of INTELLIGENT_TIERING is its frequent tier."""
    cls, access = _clean(storage_class), _clean(access_tier)
    inner = F.lit(7)
    for tid, names in ACCESS_TIERS.items():
        inner = F.when(access.isin(*names), F.lit(tid)).otherwise(inner)
    out = F.when(cls == "INTELLIGENT_TIERING", inner)
    for t in TIERS[1:]:
        out = out.when(cls == t.tier_name, F.lit(t.tier_id))
    return out.otherwise(F.lit(0)).cast("int")


def tier_id_of(storage_class: str | None, access_tier: str | None = None) -> int:
    """The same mapping for single values."""
    cls, access = (storage_class or "").strip().upper(), (access_tier or "").strip().upper()
    if cls == "INTELLIGENT_TIERING":
        return next((tid for tid, names in ACCESS_TIERS.items() if access in names), 7)
    return next((t.tier_id for t in TIERS if t.tier_name == cls), 0)


def tier_name(tid: Column) -> Column:
    """Name of a tier id; ids outside the dimension are UNKNOWN."""
    names = F.array(*[F.lit(t.tier_name) for t in TIERS])
    return F.when((tid >= 0) & (tid < N_TIERS), F.get(names, tid)).otherwise(F.lit(UNKNOWN))


def tier_name_of(tid: int) -> str:
    return TIERS[tid].tier_name if 0 <= tid < N_TIERS else UNKNOWN


def tier_dimension(spark: SparkSession) -> DataFrame:
    """(tier_id, tier_name, column_name), one row per tier."""
    rows = F.array(*[F.struct(F.lit(t.tier_id).alias("tier_id"), F.lit(t.tier_name).alias("tier_name"), F.lit(t.column).alias("column_name")) for t in TIERS])
    return spark.range(1).select(F.inline(rows))
