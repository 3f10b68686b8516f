"""Numbers for people: sizes, durations, rates, counts, and parsing of sizes.

Python's % rounds the exact binary value half to even, which is what is wanted here; Spark's
format_string rounds the decimal text half up, so these run on the driver.
"""

from __future__ import annotations

import math
import re

KIB, MIB, GIB, TIB = (1 << s for s in (10, 20, 30, 40))
#: Unit names of sizes; a single letter is binary.
UNITS = {"B": 1, "KB": 10**3, "KiB": KIB, "K": KIB, "MB": 10**6, "MiB": MIB, "M": MIB, "GB": 10**9, "GiB": GIB, "G": GIB, "TB": 10**12, "TiB": TIB, "T": TIB}


def _scaled(value: float, steps: tuple) -> str | None:
    return next((f"{value / size:.2f}{unit}" for size, unit in steps if value >= size), None)


def format_bytes(n: int) -> str:
    steps = ((TIB, " TiB"), (GIB, " GiB"), (MIB, " MiB"), (KIB, " KiB"))
    return _scaled(n, steps) or f"{n} B"


def format_count(n: int) -> str:
    return _scaled(n, ((10**9, "B"), (10**6, "M"), (10**3, "K"))) or str(n)


def format_duration(ns: int) -> str:
    """A duration in nanoseconds."""
    if ns < 0:
        return f"-{format_duration(-ns)}"
    for size, name, sub, sub_name in ((3600 * 10**9, "h", 60 * 10**9, "m"), (60 * 10**9, "m", 10**9, "s")):
        if ns >= size:
            rest = ns % size // sub
            return f"{ns // size}{name}" + (f"{rest}{sub_name}" if rest else "")
    if ns >= 10**9:
        return f"{ns / 1e9:.2f}s"
    if ns >= 10**6:
        return f"{ns / 1e6:.1f}ms"
    return f"{ns / 1e3:.1f}µs" if ns >= 10**3 else f"{ns}ns"


def format_throughput(n: int, ns: int) -> str:
    if ns <= 0:
        return "∞"
    rate = n / (ns / 1e9)
    steps = ((TIB, " TiB/s"), (GIB, " GiB/s"), (MIB, " MiB/s"), (KIB, " KiB/s"))
    return _scaled(rate, steps) or f"{rate:.0f} B/s"


def parse_size(text: str) -> int:
    """Bytes of a size such as 4GiB, 512M or 1.5GB; case matters, fractions of a byte are cut."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([A-Za-z]*)\s*", text)
    unit = UNITS.get((m[2] or "B") if m else "")
    if not m or unit is None:
        raise ValueError(f"invalid size: {text!r}")
    value = float(m[1]) * unit
    if not math.isfinite(value):
        raise ValueError(f"invalid size: {text!r}")
    return int(m[1]) * unit if m[1].isdigit() else int(value)
