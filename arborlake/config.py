"""Settings of a build: a memory budget and the Spark configuration that goes with it."""

from __future__ import annotations

import os
from dataclasses import dataclass

from arborlake.functions.human import GIB, parse_size

ENV_BUDGET = "ARBORLAKE_MEMORY"
#: Shares of the budget by purpose, and what is assumed where memory can't be told.
SHARES = {"aggregation": 0.50, "buffers": 0.20, "merge": 0.15, "index": 0.10, "reserve": 0.05}
DEFAULT_BUDGET, UNKNOWN_RAM = 8 * GIB, 4 * GIB


def total_ram() -> tuple[int, bool]:
    """(bytes, whether that is known)."""
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES"), True
    except (ValueError, OSError, AttributeError):
        return UNKNOWN_RAM, False


@dataclass(frozen=True)
class MemoryBudget:
    total: int = DEFAULT_BUDGET
    source: str = "default"

    def share(self, purpose: str) -> int:
        return int(self.total * SHARES[purpose])

    @classmethod
    def determine(cls, stated: str | None = None) -> MemoryBudget:
        """A stated size, else the environment's, else half of the machine's memory."""
        for value, source in ((stated, "flag"), (os.environ.get(ENV_BUDGET), "environment")):
            if value:
                return cls(parse_size(value), source)
        ram, known = total_ram()
        return cls(ram // 2, "half of memory" if known else "half of an assumed memory")

    def spark_conf(self, workers: int = 0) -> dict[str, str]:
        """Settings for a session of this machine alone."""
        conf = {
            "spark.master": f"local[{workers or '*'}]",
            "spark.driver.memory": f"{max(512, self.total // (1 << 20))}m",
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.io.compression.codec": "zstd",
            "spark.sql.shuffle.partitions": str(max(8, 2 * (workers or os.cpu_count() or 4))),
            "spark.ui.showConsoleProgress": "false",
        }
        return conf
