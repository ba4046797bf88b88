"""The entity model: one wide table with a discriminator, and columns that are null where a type has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import derive

# Fixed value: the order in which providers answer, which breaks ties.
PROVIDER_ORDER = {"application": 0, "process": 1, "file": 2, "directory": 2, "service": 3, "window": 4}

COLUMNS = {
    "entity_type": "string", "name": "string", "svc_display_name": "string", "path": "string", "extension": "string",
    "drive": "string", "size": "bigint", "modified": "bigint", "created": "bigint", "file_id": "bigint", "pid": "bigint",
    "parent_pid": "bigint", "session_id": "bigint", "memory_bytes": "bigint", "thread_count": "int", "username": "string",
    "target": "string", "arguments": "string", "working_dir": "string", "app_source": "string", "svc_state": "string",
    "svc_start_type": "string", "account": "string", "hwnd": "bigint", "process_name": "string", "class_name": "string",
    "visible": "boolean", "collect_ord": "bigint",
}
KEYS = {"file": "path", "directory": "path", "process": "pid", "application": "target", "service": "name", "window": "hwnd"}


def entities(df: DataFrame, kind: str) -> DataFrame:
    """Rows of one type with all columns of the model; df has those that the type has, and collect_ord."""
    have = set(df.columns)
    out = df.select(
        F.lit(kind).alias("entity_type"),
        *(
            (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
            for c, t in COLUMNS.items()
            if c != "entity_type"
        ),
    )
    return with_derived(out, kind)


def with_derived(df: DataFrame, kind: str) -> DataFrame:
    """Adds id, display_name, lowered name and path (stored, so that filters on them reach the scan) and provider_ord."""
    out = df
    if kind in ("process", "application"):
        out = out.withColumn("extension", F.coalesce("extension", derive.extension_of(F.col("path"))))
    if kind in ("process", "application", "service"):
        out = out.withColumn("drive", F.coalesce("drive", derive.drive_of(F.col("path"))))
    return out.select(
        "*",
        derive.entity_id(kind, F.col(KEYS[kind])).alias("id"),
        derive.display_name().alias("display_name"),
        F.lower("name").alias("lname"),
        F.lower("path").alias("lpath"),
        F.lit(PROVIDER_ORDER[kind]).alias("provider_ord"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
