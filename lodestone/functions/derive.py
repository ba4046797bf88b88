"""Columns that are derived from an entity's own: identity, names, path parts, subtitle and metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identity prefixes, labels, and metadata keys with the columns they come from, by type.
ID_PREFIX = {"file": "file:", "directory": "dir:", "process": "process:", "application": "app:", "service": "service:", "window": "window:"}
LABELS = {"file": "File", "directory": "Folder", "process": "Process", "application": "Application", "service": "Service", "window": "Window"}
METADATA = {
    "file": {"path": "path", "size_bytes": "size", "extension": "extension", "modified_unix_ms": "modified",
             "created_unix_ms": "created", "drive": "drive", "file_id": "file_id"},
    "directory": {"path": "path", "modified_unix_ms": "modified", "drive": "drive", "file_id": "file_id"},
    "process": {"pid": "pid", "memory_bytes": "memory_bytes", "thread_count": "thread_count", "exe_path": "path",
                "parent_pid": "parent_pid", "start_unix_ms": "modified", "username": "username", "session_id": "session_id"},
    "application": {"target": "target", "source": "app_source", "arguments": "arguments", "working_dir": "working_dir"},
    "service": {"service_name": "name", "display_name": "svc_display_name", "state": "svc_state",
                "start_type": "svc_start_type", "binary_path": "path", "account": "account", "pid": "pid"},
    "window": {"hwnd": "hwnd", "pid": "pid", "visible": "visible", "process_name": "process_name", "class_name": "class_name"},
}


def by_type(choices: dict[str, Column]) -> Column:
    kind = F.col("entity_type")
    return reduce(lambda out, c: F.when(kind == c[0], c[1]).otherwise(out), choices.items(), F.lit(None))


def entity_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX[kind]), F.lower(key.cast("string")))


def label() -> Column:
    return by_type({k: F.lit(v) for k, v in LABELS.items()})


def display_name() -> Column:
    own = F.when(F.col("svc_display_name") != "", F.col("svc_display_name"))
    return F.when(F.col("entity_type") == "service", F.coalesce(own, F.col("name"))).otherwise(F.col("name"))


def extension_of(path: Column, longest: int = 32, split_path: bool = True) -> Column:
    """What follows the last dot of the last path component, its case kept; null without a stem or if too long."""
    name = F.regexp_extract(path, r"([^\\/]*)$", 1) if split_path else path
    ext = F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1)
    return F.when((ext != "") & (F.octet_length(ext) <= longest), ext)


def drive_of(path: Column) -> Column:
    letter = F.upper(F.regexp_extract(path, r"^([A-Za-z]):", 1))
    return F.when(letter != "", letter)


def file_name_of(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"[\\/]+$", ""), r"([^\\/]*)$", 1)


def prettify(raw: Column) -> Column:
    """A file name as words: no .exe, separators to spaces, first letters to upper case."""
    stem = F.when(F.lower(raw).rlike(r"(?s)^.+\.exe$"), F.substring(raw, F.lit(1), F.length(raw) - 4)).otherwise(raw)
    words = F.filter(F.split(stem, r"[\s\-_.]+"), lambda w: w != "")
    tall = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.when(F.size(words) > 0, F.array_join(tall, " ")).otherwise(stem)


def subtitle() -> Column:
    def joined(*parts: Column) -> Column:
        return F.concat_ws(" · ", *parts)

    mb = F.when(F.col("memory_bytes") > 0, F.format_string("%.0f MB", F.rint(F.col("memory_bytes") / 1048576.0)))
    pid = F.concat(F.lit("PID "), F.col("pid").cast("string"))
    owner = F.when(F.col("process_name") != "", F.col("process_name"))
    return by_type(
        {
            "file": F.coalesce("path", F.lit("")),
            "directory": F.coalesce("path", F.lit("")),
            "process": joined(pid, mb, F.col("path")),
            "application": joined(F.col("app_source"), F.col("target")),
            "service": joined(F.col("svc_state"), F.col("svc_start_type"), F.col("path")),
            "window": joined(owner, pid),
        }
    )


def metadata() -> Column:
    """A flat map of what an entity has; keys without a value are left out."""
    maps = {
        kind: F.map_from_entries(
            F.array(
                *(
                    F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"))
                    for k, c in {"entity_type": "entity_type", **keys}.items()
                )
            )
        )
        for kind, keys in METADATA.items()
    }
    return F.map_filter(by_type(maps), lambda k, v: v.isNotNull())
