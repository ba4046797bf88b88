"""Providers over recorded snapshots: services, windows, applications, volumes and volume enumerations.

What a machine's interfaces would list is read as DataFrames, from any source that Spark has (JSON lines, Parquet, the
walk source), and brought into the entity model.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions import derive
from lodestone.operators import tree
from lodestone.plans.query import SearchQuery
from lodestone.sources import snapshots

# How deep menus are walked, and how many shortcuts and executables a source may list.
MENU_DEPTH, MOST_SHORTCUTS, MOST_EXECUTABLES = 5, 5_000, 20_000
DIRECTORY = 0x10
VOLUME = "volume_id string, mount_points array<string>, file_system string, total long, free long"
#: File systems that are no volumes of files.
UNREAL = ("proc", "sysfs", "devpts", "tmpfs", "devtmpfs", "cgroup", "cgroup2", "mqueue", "securityfs", "debugfs", "tracefs", "bpf", "overlay")


def wants_config(query: SearchQuery) -> Column:
    """Whether a service's configuration can matter to a query: all do with a state or path filter or without text, else
    those with a word of it in the name or the display name."""
    words = (query.text or "").lower().split()
    if not words or any(f.kind in ("state", "path") for f in query.filters):
        return F.lit(True)
    names = F.lower("name"), F.lower(F.coalesce("svc_display_name", F.lit("")))
    return reduce(Column.__or__, (n.contains(w) for n in names for w in words))


def services(listed: DataFrame, config: DataFrame) -> snapshots.Snapshot:
    """listed: name, svc_display_name, svc_state, pid, collect_ord; config: name, svc_start_type, account, path.

    Only the configuration of services that the query can want is joined, so little of it is read for a few words. The
    answer depends on the query, so it is not kept from one query to the next.
    """

    def take(query: SearchQuery) -> DataFrame:
        wanted = listed.where(wants_config(query)).select("name")
        found = config.join(wanted, "name", "left_semi")
        return model.entities(listed.join(found, "name", "left"), "service")

    return snapshots.Snapshot("services", ("service",), take, kept=-1.0)


def windows(listed: DataFrame, processes: DataFrame) -> snapshots.Snapshot:
    """listed: name (the title), hwnd, pid, class_name, visible, collect_ord; processes: pid, name. Untitled ones go."""
    return snapshots.Snapshot("windows", ("window",), lambda query: model.entities(snapshots.windows(listed, processes), "window"))


def app_paths(registered: DataFrame) -> DataFrame:
    """registered: key (the executable's name), target, working_dir, collect_ord -> applications; blank targets go."""
    kept = registered.where(F.trim(F.coalesce("target", F.lit(""))) != "")
    return _apps(kept.withColumn("name", derive.prettify(F.col("key"))), "app-paths")


def start_menu(walked: DataFrame, root: str) -> DataFrame:
    """Shortcuts that a walk of root (sources/walk.py) has found, not too deep; the first of them by path."""
    inside = F.substring(F.col("path"), len(root.rstrip("\\/")) + 2, 1 << 20)
    depth = F.size(F.split(inside, r"[\\/]")) - 1
    kept = walked.where(~F.col("is_dir") & (depth <= MENU_DEPTH))
    return _files(kept, "lnk", "start-menu", MOST_SHORTCUTS)


def executables(walked: DataFrame, folders: list[str], source: str) -> DataFrame:
    """Executables that a walk has found directly in folders; of source path the first of them by path."""
    own = F.regexp_replace("path", r"[\\/][^\\/]*$", "")
    kept = walked.where(~F.col("is_dir") & own.isin([f.rstrip("\\/") for f in folders]))
    return _files(kept, "exe", source, MOST_EXECUTABLES if source == "path" else None)


def _files(walked: DataFrame, extension: str, source: str, most: int | None) -> DataFrame:
    stem = F.regexp_extract("name", rf"(?i)^(.*)\.{extension}$", 1)
    kept = walked.where(F.trim(stem) != "")
    # The limit is the source's own: a catalogue is no file index.
    kept = kept.orderBy("path").limit(most) if most else kept
    kept = kept.select(
        derive.prettify(stem).alias("name"), F.col("path").alias("target"), F.regexp_replace("path", r"[\\/][^\\/]*$", "").alias("working_dir"),
        F.xxhash64("path").alias("collect_ord"),
    )
    return _apps(kept, source)


def _apps(rows: DataFrame, source: str) -> DataFrame:
    return model.entities(rows.withColumns({"app_source": F.lit(source), "path": F.col("target")}), "application")


def applications(sources: list[DataFrame]) -> snapshots.Snapshot:
    """The catalogue: one application a target, of the best source."""
    return snapshots.Snapshot("applications", ("application",), lambda query: snapshots.applications(sources))


def enumerated(records: DataFrame, drive: str) -> DataFrame:
    """records(frn, parent_frn, name, attributes, modified) of a volume -> its files and directories, as entities.

    The root is its own parent or has none; what hangs on no root drops out. An enumeration tells no sizes and no times of
    creation, so these are null.
    """
    graph = records.select(F.col("frn").alias("id"), F.col("parent_frn").alias("parent_id"), "name")
    root = (F.col("parent_id") == F.col("id")) | F.col("parent_id").isNull() | (F.col("parent_id") == 0)
    graph = graph.withColumn("name", F.when(root, f"{drive.upper()}:\\").otherwise(F.col("name")))
    found = tree.paths(graph).join(records, F.col("id") == F.col("frn")).where("depth > 0")
    rows = found.select(
        "name", "path", F.lit(drive.upper()).alias("drive"), F.col("frn").alias("file_id"), "modified", F.col("frn").alias("collect_ord"),
        (F.col("attributes").bitwiseAND(F.lit(DIRECTORY)) != 0).alias("is_dir"),
    )
    files = rows.where("NOT is_dir").withColumn("extension", derive.extension_of(F.col("name"), split_path=False))
    return model.union([model.entities(files, "file"), model.entities(rows.where("is_dir"), "directory")])


def read_volumes(mounts: str = "/proc/mounts", usage=os.statvfs) -> Iterable[tuple]:
    """Rows of VOLUME: each device once, with its mount points; what cannot be asked for its sizes has none."""
    found: dict[str, tuple[list[str], str]] = {}
    with open(mounts) as f:
        for line in f:
            device, point, kind = line.split()[:3]
            if kind not in UNREAL:
                found.setdefault(device.lower(), ([], kind))[0].append(point)
    for device, (points, kind) in sorted(found.items()):
        try:
            s = usage(points[0])
            yield device, points, kind, s.f_blocks * s.f_frsize, s.f_bavail * s.f_frsize
        except OSError:
            yield device, points, kind, None, None


def volumes(spark: SparkSession, mounts: str = "/proc/mounts") -> DataFrame:
    return spark.createDataFrame(list(read_volumes(mounts)), VOLUME)
