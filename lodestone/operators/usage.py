"""What was chosen before: an aggregate of a log of selections, bounded by a capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, LEAST_CAPACITY = 2048, 16


def usage_of(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """log(entity_id, query, ts_ms) -> entity_id, query (the last), selection_count, last_selected_ms; the latest stay."""
    return (
        log.where("entity_id <> ''")
        .groupBy("entity_id")
        .agg(
            F.max_by("query", F.struct("ts_ms", "query")).alias("query"),
            F.count("*").alias("selection_count"),
            F.max("ts_ms").alias("last_selected_ms"),
        )
        .orderBy(F.desc("last_selected_ms"), "entity_id")
        .limit(max(LEAST_CAPACITY, capacity))
    )


def recent(usage: DataFrame, n: int) -> DataFrame:
    return usage.orderBy(F.desc("last_selected_ms"), "entity_id").limit(n)
