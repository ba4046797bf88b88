"""Providers of live things: a snapshot that is kept for a while, and processes as this machine has them."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import model
from lodestone.operators import catalogue
from lodestone.plans.query import SearchQuery

# For how many seconds a snapshot of each type is good.
KEPT = {"process": 0.25, "window": 0.25, "service": 5.0, "application": 300.0}

PROCESS = "name string, path string, pid long, parent_pid long, memory_bytes long, thread_count int, username string, modified long, collect_ord long"


@dataclass
class Snapshot:
    """A provider that asks ``take`` for rows and keeps the answer for ``kept`` seconds."""

    name: str
    types: tuple[str, ...]
    take: Callable[[SearchQuery], DataFrame]
    kept: float | None = None
    scope: str = "live"
    _at: float = field(default=float("-inf"), repr=False)
    _rows: DataFrame | None = field(default=None, repr=False)

    def collect(self, query: SearchQuery) -> DataFrame:
        kept = KEPT.get(self.types[0], 0.0) if self.kept is None else self.kept
        if self._rows is None or time.monotonic() - self._at > kept:
            self.refresh()
            self._rows, self._at = self.take(query), time.monotonic()
            if kept > 0:
                # Taken once, however many actions read it.
                self._rows.persist()
        return self._rows

    def refresh(self) -> None:
        if self._rows is not None:
            self._rows.unpersist()
        self._rows = None


def read_processes(root: str = "/proc") -> Iterable[tuple]:
    """Rows of PROCESS from a /proc folder; what cannot be read is null, and a process that is gone is left out."""
    tick, page = os.sysconf("SC_CLK_TCK"), os.sysconf("SC_PAGE_SIZE")
    try:
        with open(f"{root}/stat") as f:
            boot = next((int(line.split()[1]) for line in f if line.startswith("btime")), 0)
    except OSError:
        boot = 0
    for pid in sorted(int(p) for p in os.listdir(root) if p.isdigit()):
        try:
            with open(f"{root}/{pid}/stat") as f:
                head, _, rest = f.read().rpartition(")")
        except OSError:
            continue
        parts = rest.split()
        try:
            path = os.readlink(f"{root}/{pid}/exe")
        except OSError:
            path = None
        started = boot * 1000 + int(parts[19]) * 1000 // tick
        yield head.partition("(")[2], path, pid, int(parts[1]), int(parts[21]) * page, int(parts[17]), None, started, pid


def processes(spark: SparkSession, root: str = "/proc") -> Snapshot:
    """The machine's processes, as the driver sees them."""

    def take(query: SearchQuery) -> DataFrame:
        return model.entities(spark.createDataFrame(list(read_processes(root)), PROCESS), "process")

    return Snapshot("processes", ("process",), take)


def windows(rows: DataFrame, processes_: DataFrame) -> DataFrame:
    """Windows with a title, each with its process's image name."""
    titled = rows.where(F.trim("name") != "").drop("process_name")
    images = processes_.select("pid", F.col("name").alias("process_name"))
    return titled.join(images, "pid", "left")


def applications(sources: list[DataFrame]) -> DataFrame:
    """The catalogue of several sources' applications, one a target."""
    return catalogue.deduplicated(model.union(sources))
