"""The grammar of sizes in inventories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest size that can be kept; larger unsigned sizes are cut to it.
MAX_SIZE = 2**63 - 1
MAX_UNSIGNED = 2**64 - 1


def size_expr(token: Column) -> Column:
    """A size token as bigint: an unsigned decimal number with white space around, else 0.

    Signs, fractions, other letters and numbers over 64 unsigned bits are invalid, so 0. Numbers over
    63 bits, which only a malformed listing holds, are cut to the largest bigint; sums that overflow
    then raise an error instead of wrapping around.
    """
    plain = F.regexp_replace(F.coalesce(token, F.lit("")), "^[\\s\\u0085\\u00A0]+|[\\s\\u0085\\u00A0]+$", "")
    digits = F.regexp_replace(plain, "^0+(?=[0-9])", "")
    number = F.when(F.regexp_like(plain, F.lit("^[0-9]+$")) & (F.length(digits) <= 20), digits.try_cast("decimal(20,0)"))
    inside = F.when(number <= F.lit(str(MAX_UNSIGNED)).cast("decimal(20,0)"), F.least(number, F.lit(str(MAX_SIZE)).cast("decimal(20,0)")))
    return F.coalesce(inside.cast("bigint"), F.lit(0).cast("bigint"))
