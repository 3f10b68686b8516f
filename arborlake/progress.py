"""Progress of long work: rates, the time left, completion events; and where memory goes."""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.human import format_bytes, format_count, format_duration

log = logging.getLogger("arborlake")


@dataclass
class Progress:
    """Counts work done against a total (0: unknown) and reports at most every ``every`` seconds."""

    what: str
    total: int = 0
    every: float = 5.0
    clock: Callable[[], float] = time.monotonic
    done: int = 0
    events: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.began = self.reported = self.clock()

    @property
    def seconds(self) -> float:
        return self.clock() - self.began

    @property
    def rate(self) -> float:
        """Units a second so far."""
        return self.done / self.seconds if self.seconds > 0 else 0.0

    @property
    def share(self) -> float | None:
        return min(1.0, self.done / self.total) if self.total > 0 else None

    @property
    def left(self) -> float | None:
        """Seconds that the rest takes at the rate so far; None where it can't be told."""
        if self.total <= 0 or not self.rate:
            return None
        return max(0, self.total - self.done) / self.rate

    def add(self, n: int = 1) -> None:
        self.done += n
        if self.clock() - self.reported >= self.every:
            self.reported = self.clock()
            self._event("progress")

    def finish(self, **more) -> dict:
        """The completion event, with whatever else is worth knowing."""
        return self._event("done", **more)

    def _event(self, kind: str, **more) -> dict:
        event = {"event": kind, "what": self.what, "done": self.done, "total": self.total or None, "seconds": round(self.seconds, 3), "rate": round(self.rate, 1), "share": self.share, "left": self.left, **more}
        self.events.append(event)
        log.info("%s", json.dumps(event))
        return event

    def __str__(self) -> str:
        parts = [f"{self.what}: {format_count(self.done)}"]
        if self.total > 0:
            parts.append(f"of {format_count(self.total)} ({100 * self.share:.0f} %)")
        if self.left is not None:
            parts.append(f"{format_duration(int(self.left * 1e9))} left")
        return ", ".join(parts)


def observed(objects: DataFrame, name: str = "objects") -> tuple[DataFrame, Observation]:
    """Objects (key, size) and an observation of them, which has ``objects``, ``bytes`` and ``longest_key`` as soon as an
    action on the frame is over; it costs no pass of its own."""
    seen = Observation(name)
    return objects.observe(seen, F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.max(F.length("key")).alias("longest_key")), seen


def running_stages(spark: SparkSession) -> list[dict]:
    """(stage, tasks, completed, failed, share) of what runs now."""
    tracker = spark.sparkContext.statusTracker()
    out = []
    for stage in tracker.getActiveStageIds():
        info = tracker.getStageInfo(stage)
        if info:
            out.append({"stage": stage, "name": info.name, "tasks": info.numTasks, "completed": info.numCompletedTasks, "failed": info.numFailedTasks, "share": info.numCompletedTasks / info.numTasks if info.numTasks else 1.0})
    return out


#: Bytes of a listing's record where nothing better is known.
RECORD_BYTES = 120


def expected_objects(listing_bytes: int, sample: bytes = b"", *, gzip: bool = False) -> int:
    """How many objects listings of so many bytes may hold, by the length of a sample's lines; gzip listings
    are taken to be a tenth of their text. For progress and partition counts, never for results."""
    lines = sample.count(b"\n")
    record = len(sample) / lines if lines else RECORD_BYTES
    return int(listing_bytes * (10 if gzip else 1) / record)


def memory_report(spark: SparkSession) -> dict[str, dict[str, int]]:
    """Bytes by place: storage memory of every executor (most, left), the driver's heap (used, most) and this
    process (resident)."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    out = {"driver heap": {"used": runtime.totalMemory() - runtime.freeMemory(), "most": runtime.maxMemory()}}
    status = spark._jsc.sc().getExecutorMemoryStatus()
    names = status.keys().iterator()
    while names.hasNext():
        name = names.next()
        room = status.apply(name)
        out[f"executor {name}"] = {"most": room._1(), "left": room._2()}
    try:
        with open("/proc/self/statm", encoding="ascii") as f:
            out["process"] = {"resident": int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")}
    except OSError:
        pass
    return out


def describe(report: dict[str, dict[str, int]]) -> str:
    return "; ".join(f"{place}: " + ", ".join(f"{k} {format_bytes(v)}" for k, v in sizes.items()) for place, sizes in report.items())
